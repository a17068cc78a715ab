"""Boolean matching and the tiered cascade over q(query_id, term, qtf) and postings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.products import shared_sums
from textmill.shared import stored


def _shared(q: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, doc_id, n): how many terms they share."""
    return shared_sums(q.select("query_id", "term"), postings.select("doc_id", "term", F.lit(1).alias("x")), ["n"], lambda x, _: (x,))


def _sizes(q: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, m): how many known terms a query has."""
    known = postings.join(F.broadcast(q.select("term").distinct()), "term", "left_semi").select("term").distinct()
    return q.join(F.broadcast(known), "term").groupBy("query_id").agg(F.count_distinct("term").alias("m"))


def conjunctive(q: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, doc_id) of documents with all of a query's known terms."""
    return _shared(q, postings).join(F.broadcast(_sizes(q, postings)), "query_id").where("n = m").select("query_id", "doc_id")


def disjunctive(q: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, doc_id) of documents with any of a query's terms."""
    return _shared(q, postings).select("query_id", "doc_id")


def cascade(q: DataFrame, tiered: DataFrame, min_docs: int) -> DataFrame:
    """(query_id, doc_id, stage) of the first stage that has min_docs documents; no row if none has.

    Stages: all terms in the high tier; all terms in either; any term in the high tier; any term. The first
    two need tf >= qtf. Unknown terms are ignored. One pass: flags per document, counts per query.
    """
    signed = tiered.select("doc_id", "term", F.when(F.col("tier") == "high", F.col("tf")).otherwise(-F.col("tf")).alias("x"))  # the sign is the tier

    def counts(qtf, x, _):
        enough, high = np.abs(x) >= qtf, x > 0
        return enough & high, enough, high

    docs = shared_sums(q.select("query_id", "term", "qtf"), signed, ["n_high", "n_all", "any_high"], counts).join(F.broadcast(_sizes(q, tiered)), "query_id")
    flags = F.array(F.col("n_high") == F.col("m"), F.col("n_all") == F.col("m"), F.col("any_high") > 0, F.lit(True))
    docs = stored(docs.select("query_id", "doc_id", flags.alias("flags")), "flags")
    sizes = docs.groupBy("query_id").agg(*[F.count_if(F.col("flags")[i]).alias(f"n{i}") for i in range(4)])
    stage = F.coalesce(*[F.when(F.col(f"n{i}") >= min_docs, i) for i in range(4)])
    first = sizes.select("query_id", stage.alias("stage")).where("stage is not null")
    return docs.join(F.broadcast(first), "query_id").where(F.expr("flags[stage]")).select("query_id", "doc_id", (F.col("stage") + 1).alias("stage"))
