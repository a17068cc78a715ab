"""Ranking functions over a batch of queries q(query_id, term, qtf).

A scorer takes the queries and the index and gives scores(query_id, doc_id, score). Small sides are left to
the planner, which broadcasts by size; one-row statistics are joined as such.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators import index as I
from textmill.operators.products import shared_sums
from textmill.shared import stored


class Index(NamedTuple):
    """The tables of an index. stats is one row."""

    postings: DataFrame
    terms: DataFrame
    doc_len: DataFrame
    stats: DataFrame


Scorer = Callable[..., DataFrame]


def build(docs: DataFrame, keep: bool = False, **analysis) -> Index:
    """An index of docs(doc_id, text); analysis as for terms_of. With keep, the postings are persisted, as all else derives from them."""
    posts = I.doc_postings(docs, **analysis)
    if keep:
        posts = posts.persist(StorageLevel.MEMORY_AND_DISK)
    lengths = I.own_lengths(docs, **analysis) if I.has_distinct_ids(docs) else I.doc_lengths(docs, posts)
    return Index(posts, I.term_stats(posts), lengths, I.corpus_stats(lengths))


def query_terms(queries: DataFrame, **analysis) -> DataFrame:
    """queries(query_id, text) to q(query_id, term, qtf)."""
    terms = I.terms_of(queries.withColumnRenamed("query_id", "doc_id"), **analysis)
    return terms.groupBy(F.col("doc_id").alias("query_id"), "term").agg(F.count("*").alias("qtf"))


def restricted(q: DataFrame, index: Index) -> Index:
    """The index of the queries' terms alone, in one pass over the postings; lengths and statistics are of all terms."""
    posts = stored(index.postings.join(F.broadcast(q.select("term").distinct()), "term", "left_semi"), "postings")
    lengths = stored(index.doc_len, "lengths")
    return Index(posts, I.term_stats(posts), lengths, I.corpus_stats(lengths))


def known_terms(q: DataFrame, index: Index) -> DataFrame:
    """q with the known terms' statistics; only the queries' terms are counted."""
    return q.join(index.terms.join(F.broadcast(q.select("term").distinct()), "term", "left_semi"), "term").crossJoin(index.stats)


def _occurrences(index: Index) -> DataFrame:
    return index.postings.select("doc_id", "term", F.col("tf").alias("x"))


def _lengths(index: Index) -> DataFrame:
    return index.doc_len.select("doc_id", F.col("dl").alias("x")).distinct()


Best = tuple[int, int | None]  # so many of a query, on scores of so many digits


def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0."""
    a, b = np.broadcast_arrays(a, b)
    return np.divide(a, b, out=np.zeros(a.shape), where=b != 0)


def cosine(q: DataFrame, index: Index, candidates: DataFrame | None = None, best: Best | None = None) -> DataFrame:
    """Sum of (idf qtf)(idf tf) over the document's length in tokens, for matching documents; unknown terms are ignored.

    With candidates (query_id, doc_id), all and only those are scored, 0 included. With best, scores may be left out
    that top_k of so many leaves out.
    """
    idf = F.log10(F.col("n_docs") / F.col("df"))
    asked = known_terms(q, index).select("query_id", "term", (idf * F.col("qtf") * idf).alias("w"))
    sums = shared_sums(asked, _occurrences(index), ["score"], lambda w, tf, dl: (w * tf,), _lengths(index), candidates, final=lambda s, dl, w: over(s, dl), best=best)
    return sums.select("query_id", "doc_id", "score")


def bm25(q: DataFrame, index: Index, candidates: DataFrame | None = None, k1: float = 1.2, b: float = 0.75, every_doc: bool = False, best: Best | None = None) -> DataFrame:
    """Sum of idf tf (k1 + 1) / (tf + k1 (1 - b + b dl / avg)), idf = log10(N / df); qtf isn't used.

    Matching documents only; with every_doc all documents for each query, others at 0.
    """
    asked = known_terms(q, index).select("query_id", "term", F.log10(F.col("n_docs") / F.col("df")).alias("idf"), F.coalesce("avg_dl", F.lit(0.0)).alias("avg"))

    def part(idf, avg, tf, dl):
        return (idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * over(dl, avg))),)

    every = q.select("query_id") if every_doc and candidates is None else None
    return shared_sums(asked, _occurrences(index), ["score"], part, _lengths(index), candidates, every, lambda s, dl, idf, avg: s, best).select("query_id", "doc_id", "score")


def top_k(scores: DataFrame, k: int, digits: int | None = None, of: str = "doc_id") -> DataFrame:
    """ranked(query_id, rank, doc_id, score): best first, ties to the smaller id; with digits on rounded scores.

    of: the column of what is ranked, such as category.
    """
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), of)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", of, "score")


def _probability(smoothing: str, param: float, tf: Column, length: Column) -> Column:
    if smoothing == "additive":
        return (param + tf) / (param * F.col("n_terms") + length)
    if smoothing == "jelinek-mercer":
        return param * F.coalesce(F.try_divide(tf, length), F.lit(0.0)) + (1 - param) * F.col("cf") / F.col("total")
    raise ValueError(f"unknown smoothing: {smoothing}")


def language_model(q: DataFrame, candidates: DataFrame, index: Index, smoothing: str = "additive", param: float = 0.1, n_terms: int | None = None) -> DataFrame:
    """Query likelihood of candidates (query_id, doc_id): product over the query's distinct terms; an unknown term makes it 0.

    The logarithms for documents without a term are summed by query; those of the shared terms are added as differences.
    n_terms: how many terms there are, if the index has not all.
    """
    if smoothing not in ("additive", "jelinek-mercer"):
        raise ValueError(f"unknown smoothing: {smoothing}")
    additive = smoothing == "additive"
    bare = param == (0 if additive else 1)  # nothing is smoothed: a document without a term has none of the query
    known = q.join(index.terms.join(F.broadcast(q.select("term").distinct()), "term", "left_semi"), "term", "left")
    known = stored(known.select("query_id", "term", "cf"), "known")
    n_terms = 0 if not additive else index.terms.count() if n_terms is None else n_terms
    total = index.stats.first()["total_dl"]
    absent = F.lit(0.0) if additive or bare else F.log10((1 - param) * F.col("cf") / total)
    by_query = known.groupBy("query_id").agg(F.bool_or(F.col("cf").isNull()).alias("unknown"), F.count("*").alias("m"), F.sum(absent).alias("absent"))

    def part(cf, tf, dl):
        p = (param + tf) / (param * n_terms + dl) if additive else param * tf / dl + (1 - param) * cf / total
        if bare:
            return np.log10(p), np.ones(len(p))
        return np.log10(p) - np.log10(param / (param * n_terms + dl) if additive else (1 - param) * cf / total), np.ones(len(p))

    sums = shared_sums(known.where("cf is not null"), _occurrences(index), ["more", "n"], part, _lengths(index), candidates)
    log = F.col("absent") + F.col("more") + (F.col("m") * F.log10(param / (param * n_terms + F.col("beside"))) if additive and not bare else 0.0)
    scored = sums.join(F.broadcast(by_query), "query_id").select("query_id", "doc_id", F.when(~F.col("unknown") & ((F.col("n") == F.col("m")) | F.lit(not bare)), log).alias("log_score"))
    return scored.select("query_id", "doc_id", F.coalesce(F.pow(F.lit(10.0), "log_score"), F.lit(0.0)).alias("score"), "log_score")


def _multiplied(grid, p: Column) -> DataFrame:
    """score: the product; log_score: its decimal logarithm, which doesn't run empty for long queries; null where a factor is 0."""
    return grid.agg(F.product(p).alias("score"), F.when(F.min(p) > 0, F.sum(F.log10(p))).alias("log_score"))


def category_language_model(q: DataFrame, categories: DataFrame, index: Index, smoothing: str = "additive", param: float = 0.1) -> DataFrame:
    """Likelihood of each query under each category (category, doc_id): its documents together; no length gives 0."""
    sizes = index.terms.agg(F.count("*").alias("n_terms"), F.sum("cf").alias("total"))
    lengths = categories.join(index.doc_len, "doc_id").groupBy("category").agg(F.sum("dl").alias("length"))
    wanted = index.postings.join(F.broadcast(q.select("term").distinct()), "term")
    counts = categories.join(wanted, "doc_id").groupBy("category", "term").agg(F.sum("tf").alias("tf"))
    known = q.join(index.terms.join(F.broadcast(q.select("term").distinct()), "term", "left_semi"), "term", "left").crossJoin(sizes)
    grid = known.crossJoin(lengths).join(counts, ["category", "term"], "left")  # queries' terms by categories, both small sets
    p = F.when(F.col("cf").isNull() | (F.col("length") == 0), 0.0).otherwise(_probability(smoothing, param, F.coalesce("tf", F.lit(0)), F.col("length")))
    return _multiplied(grid.groupBy("query_id", "category"), p)


def described(ranked: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Categories with their description, or the code where it is missing or empty."""
    return ranked.join(descriptions, "category", "left").withColumn("description", F.coalesce(F.nullif("description", F.lit("")), "category"))
