"""Incremental indexing of a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textmill.operators import index as I


def postings_stream(docs: DataFrame) -> DataFrame:
    """Running postings of a stream docs(doc_id, text), for update or complete mode."""
    return I.postings(I.terms_of(docs))


def index_stream(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's postings under its number; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        I.doc_postings(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
