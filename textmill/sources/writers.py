"""Sinks: stored indexes, text index lines, summary reports. Writing replaces what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.index import index_lines

BLOCK = 1 << 20


def index(tables, path: str) -> None:
    """Index tables as Parquet; postings and terms are sorted by term, so a term reads few row groups."""
    for name, frame in zip(tables._fields, tables, strict=True):
        if "term" in frame.columns:
            frame = frame.repartitionByRange("term").sortWithinPartitions("term")
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def text_index(postings: DataFrame, path: str) -> None:
    """The line form of the index, sorted by term over all files; a frequent term has a line per BLOCK ids."""
    index_lines(postings, BLOCK).orderBy("term", "block").select("line").write.mode("overwrite").text(path)


def summary_report(scores: DataFrame, path: str) -> None:
    """summaries(doc_id, method, rouge1, summary, gold) as JSON lines, and the methods' averages beside them."""
    scores.write.mode("overwrite").json(f"{path}/summaries")
    scores.groupBy("method").agg(F.avg("rouge1").alias("rouge1")).write.mode("overwrite").json(f"{path}/averages")
