"""Summaries: sentence tables, LSA and TextRank per document, ROUGE-1 and the best of several golds.

Matrices and graphs are one document's, built in an Arrow-batched function over rows of documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import text as T

CELLS = 1 << 22  # of a matrix that is built; larger ones are worked with as entries or block by block


def sentence_table(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_no, raw, clean)."""
    return docs.select("doc_id", F.posexplode(T.sentences("text")).alias("sent_no", "raw")).withColumn("clean", T.cleaned(F.col("raw")))


def leading(times, n: int, apart: list[np.ndarray]) -> np.ndarray:
    """The leading eigenvector of a symmetric operator, orthogonal to those of apart: Lanczos, reorthogonalised."""
    most = n - len(apart)
    v = np.random.default_rng(n).normal(size=n)
    basis = np.zeros((min(most, 32), n))
    alpha, beta = [], []
    for m in range(most):
        for _ in range(2):
            for u in (*apart, *([] if not m else [None])):
                v = v - (basis[:m].T @ (basis[:m] @ v) if u is None else u * (u @ v))
        size = np.linalg.norm(v)
        if m:
            if size <= 1e-13 * top:
                break
            beta.append(size)
        if m == len(basis):
            basis = np.concatenate([basis, np.zeros((min(m, most - m), n))])
        basis[m] = v / size
        v = times(basis[m])
        alpha.append(basis[m] @ v)
        values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1))
        top, s = abs(values).max(), vectors[:, -1]
        rest = v - alpha[m] * basis[m] - (beta[m - 1] * basis[m - 1] if m else 0)
        if np.linalg.norm(rest) * abs(s[-1]) <= 1e-12 * top:
            break
    best = basis[: len(s)].T @ s
    return best / np.linalg.norm(best)


def lsa_pick(sentences: list[list[str]], cells: int = CELLS) -> list[int]:
    """Two sentence numbers: the strongest in the first right singular vector, then another in the second.

    A word's weight in a sentence is its share of the sentence's words, those that occur once in the document left
    out, times ln(sentences / sentences that have it). One or two sentences are taken as they are.
    """
    n = len(sentences)
    if n <= 2:
        return list(range(n))
    counts = Counter(w for s in sentences for w in s)
    words = sorted(w for w, c in counts.items() if c > 1)
    if not words:
        return [0, 1]
    row = {w: i for i, w in enumerate(words)}
    if len(words) * n > cells:
        entries = Counter((row[w], j) for j, s in enumerate(sentences) for w in s if w in row)
        at, of = np.array(list(entries), np.int64).T
        value = np.array(list(entries.values()), np.float64)
        value = value / np.bincount(of, value, n)[of] * np.log(n / np.bincount(at, minlength=len(words)))[at]
        if not value.any():
            return [0, 1]
        times = lambda x: np.bincount(of, value * np.bincount(at, value * x[of], len(words))[at], n)
        v = [leading(times, n, [])]
        if len(words) > 1:
            v.append(leading(times, n, v))
        return _two(np.abs(v).round(9))
    m = np.zeros((len(words), n))
    for j, s in enumerate(sentences):
        for w in s:
            if w in row:
                m[row[w], j] += 1
    m *= np.log(n / (m > 0).sum(axis=1))[:, None] / np.maximum(m.sum(axis=0), 1)
    return _two(np.abs(np.linalg.svd(m, full_matrices=False)[2]).round(9))


def _two(v: np.ndarray) -> list[int]:
    first = int(v[0].argmax())
    second = v[1] if len(v) > 1 else v[0]
    order = np.argsort(-second, kind="stable")
    return [first, int(next(i for i in order if i != first))]


def textrank_pick(sentences: list[list[str]], vectors: dict[str, np.ndarray], width: int, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100, cells: int = CELLS) -> list[int]:
    """Two sentence numbers by PageRank over the cosine graph of mean word vectors; ties to the later text in order."""
    n = len(sentences)
    if n <= 2:
        return list(range(n))
    x = np.zeros((n, width))
    for i, s in enumerate(sentences):
        for w in s:
            if w in vectors:
                x[i] += vectors[w]
        x[i] /= len(s) + 0.001
    norm = np.linalg.norm(x, axis=1)
    norm[norm == 0] = 1
    x /= norm[:, None]
    size = max(1, cells // n)

    def block(at: int) -> np.ndarray:
        w = np.clip(x[at : at + size] @ x.T, 0, None)
        w[np.arange(len(w)), np.arange(at, at + len(w))] = 0
        return w

    whole = block(0) if size >= n else None

    def times(v: np.ndarray) -> np.ndarray:
        return whole @ v if whole is not None else np.concatenate([block(at) @ v for at in range(0, n, size)])

    out = times(np.ones(n))
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        spread = np.where(out > 0, rank / np.where(out > 0, out, 1), 0)
        new = damping * (times(spread) + rank[out == 0].sum() / n) + (1 - damping) / n
        done = np.abs(new - rank).sum() < n * tolerance
        rank = new
        if done:
            break
    score = rank.round(9)
    return sorted(range(n), key=lambda i: (score[i], " ".join(sentences[i])), reverse=True)[:2]


def _summaries(docs: DataFrame, pick) -> DataFrame:
    """(doc_id, summary): picked raw sentences, joined by full stops; empty without sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, clean in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = [c.split() for c in clean or []]
                out.append(".".join(raw[i] for i in pick(words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "summary"])

    raw = T.sentences("text")
    frame = docs.select("doc_id", raw.alias("raw")).withColumn("clean", F.transform("raw", lambda s: T.cleaned(s)))
    return frame.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, summary string")


def lsa_summaries(docs: DataFrame) -> DataFrame:
    return _summaries(docs, lsa_pick)


def textrank_summaries(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """embeddings(word, vec): joined to each document's words, so no task holds more than its own; words without a vector count as zero."""
    raw = docs.select("doc_id", T.sentences("text").alias("raw")).withColumn("clean", F.transform("raw", lambda s: T.cleaned(s)))
    words = raw.select("doc_id", F.explode(F.array_distinct(F.filter(F.split(F.array_join("clean", " "), " "), lambda w: w != ""))).alias("word"))
    own = words.join(embeddings.select("word", "vec"), "word").groupBy("doc_id").agg(F.collect_list(F.struct("word", "vec")).alias("vectors"))
    frame = raw.join(own, "doc_id", "left").select("doc_id", "raw", "clean", "vectors.word", "vectors.vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, clean, words, vectors in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                own = {w: np.array(v, np.float64) for w, v in zip(words or [], vectors or [], strict=True)}
                picked = textrank_pick([c.split() for c in clean or []], own, len(next(iter(own.values()), (0,))))
                out.append(".".join(raw[i] for i in picked))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "summary"])

    return frame.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, summary string")


class DealtVectors:
    """The vectors of all words: a word has the row whose id is its checksum modulo the number of rows."""

    def __init__(self, ids: list[int], rows: np.ndarray, n: int):
        self.at, self.rows, self.n = {i: k for k, i in enumerate(ids)}, rows, n

    def __contains__(self, word: str) -> bool:
        return self.n > 0 and zlib.crc32(word.encode()) % self.n in self.at

    def __getitem__(self, word: str) -> np.ndarray:
        return self.rows[self.at[zlib.crc32(word.encode()) % self.n]]


def textrank_dealt(docs: DataFrame, table: DataFrame) -> DataFrame:
    """table(vec_id, embedding): sent to all tasks, so bounded by its own size, however many words there are."""
    n, rows = table.count(), table.where("vec_id is not null and embedding is not null").orderBy("vec_id").toArrow()
    values = rows.column("embedding").combine_chunks()
    width = len(values[0]) if len(values) else 1
    vectors = DealtVectors(rows.column("vec_id").to_pylist(), np.asarray(values.flatten(), np.float32).reshape(-1, width), n)
    box = docs.sparkSession.sparkContext.broadcast(vectors)
    return _summaries(docs, lambda s: textrank_pick(s, box.value, width))


def rouge_scores(summaries: DataFrame, golds: DataFrame) -> DataFrame:
    """(doc_id, rouge1, gold): each summary(doc_id, summary) against its best gold(doc_id, n, text); ties to the first n."""

    def words(c: str):
        return F.filter(F.split(T.cleaned(F.col(c)), " "), lambda w: w != "")

    rows = summaries.join(golds, "doc_id").withColumn("rouge1", T.rouge1(words("text"), words("summary")))
    best = Window.partitionBy("doc_id").orderBy(F.desc("rouge1"), "n")
    return rows.withColumn("i", F.row_number().over(best)).where("i = 1").select("doc_id", "rouge1", F.col("text").alias("gold"))
