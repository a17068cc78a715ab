"""The engine's two entry points: exact and inexact answers to a batch of raw queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.operators import index as I
from textmill.operators import matching, scoring, summarize, tolerant
from textmill.operators.expand import expanded
from textmill.shared import stored


def _normalised(queries: DataFrame, docs: DataFrame, repair: bool, lexicon: DataFrame | None, k: int, **analysis) -> DataFrame:
    """queries(query_id, text) after optional repair (words and wildcards) and expansion."""
    if not repair and lexicon is None:
        return queries
    words = queries.select("query_id", F.posexplode(F.filter(F.split(F.lower("text"), r"[^\p{L}*]+"), lambda w: w != "")).alias("pos", "word"))
    if repair:
        vocab = stored(I.vocabulary(docs, letters_only=True), "vocabulary")
        words = tolerant.repaired(words, vocab, I.kgram_index(vocab, k), k).select("query_id", "pos", F.col("repaired").alias("word"))
    if lexicon is not None:
        words = expanded(words, lexicon).withColumn("pos", F.lit(0))
    return words.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ").alias("text"))


def answers(queries: DataFrame, docs: DataFrame, top: int, scorer: scoring.Scorer = scoring.bm25, repair: bool = False, lexicon: DataFrame | None = None, tier: int | None = None, k: int = 3, digits: int | None = None, **analysis) -> DataFrame:
    """(query_id, rank, doc_id, score, summary, highlighted) of the best documents.

    With tier, only candidates of the cascade (at least `top` documents, postings of tf >= tier are high) are
    scored: the inexact answer. Only the documents that are returned are summarised and highlighted.
    With digits, documents are ranked by rounded scores.
    """
    asked = stored(_normalised(queries, docs, repair, lexicon, k, **analysis), "asked")
    q = stored(scoring.query_terms(asked, **analysis), "queries")
    tables = scoring.restricted(q, scoring.build(docs, **analysis))
    candidates = None if tier is None else matching.cascade(q, I.tiered(tables.postings, tier), top)
    ranked = stored(scoring.top_k(scorer(q, tables, candidates=candidates, best=(top, digits)), top, digits), "ranked")
    terms = asked.select("query_id", F.array_distinct(T.tokens("text")).alias("terms"))
    few = stored(docs.select("doc_id", "text").join(F.broadcast(ranked.select("doc_id").distinct()), "doc_id", "left_semi"), "hits")
    hits = ranked.join(few, "doc_id")
    summaries = summarize.lsa_summaries(few)
    return hits.join(summaries, "doc_id").join(terms, "query_id").select("query_id", "rank", "doc_id", "score", "summary", T.highlight("text", F.col("terms")).alias("highlighted"))
