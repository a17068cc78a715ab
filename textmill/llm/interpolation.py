"""Language-model scoring by deleted interpolation.

The model mixes the maximum-likelihood estimates of trigrams, bigrams and words, and a uniform one: an estimate
and all shorter ones share a token's probability by a weight that depends on how often the estimate's context
was seen (buckets of powers of two). Weights are learned by expectation-maximisation on held-out counts: every
training token is held out in turn, that is, deleted from its own counts. Shorter estimates are learned first.

Texts are kept as blocks of tokens, in numbers of a block's own words. Blocks ask for the counts of their
distinct words and bigrams, sorted by 64-bit digest and cut into digest ranges; a range's task adds up what all
blocks know of it and answers each. So a word or bigram is one entry per block, however frequent, no count
table is ever broadcast, and ranges are sized to what was asked. Then blocks ask in the same way for trigrams,
but for those with an unknown bigram, which are unknown, too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm._common import Words, given_back, mixed, slices_by_bytes
from textmill.shared import removed, scratch, shared_folder, stored

SLICE_BYTES = 6 << 20
BLOCK_TOKENS = 1 << 20  # longer texts go on in further blocks
RANGE = 1_000_000  # entries that a range's task gets, about
BUCKETS = 40
ROUNDS = 60
END, BEGIN = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
FINE = 64  # steps per octave in which ratios of held-out estimates are counted
OCTAVES = 80  # on either side of 1

WORDS, PAIRS, TRIPLES = 0, 1, 2
ORDERS = 3

CARRIED = "block long, rows binary, ids array<{id}>, train binary, starts binary, tokens binary, ghosts int, vocabulary binary"


def _put(x: np.ndarray) -> bytes:
    """An array as bytes by plane, compressed."""
    x = np.ascontiguousarray(x)
    return zlib.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1) if len(x) else b""


def _get(data: bytes, kind: str) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8).T.tobytes() if len(x) else b""


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel() if data else np.zeros(0, "<u8")


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int, np.ndarray]]:
    """Blocks of a column's tokens: rows from and to, where they start, tokens' numbers, ghosts, sorted vocabulary.

    A row's tokens are its words and an end. Where a row goes on from the block before, its last two tokens
    there come first as ghosts: they are contexts only.
    """
    words = Words(column, "space")
    digest = np.append(words.digests()[:, 0], END)
    tokens = np.insert(words.number, words.rows[1:], len(digest) - 1)
    starts = words.rows + np.arange(len(words.rows))
    for a in range(0, len(tokens), BLOCK_TOKENS):
        b = min(a + BLOCK_TOKENS, len(tokens))
        low, high = int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b, "left"))
        ghosts = min(2, a - int(starts[low]))
        own = np.maximum(starts[low : high + 1] - (a - ghosts), 0)
        own[-1] = b - (a - ghosts)
        distinct, number = np.unique(tokens[a - ghosts : b], return_inverse=True)
        order = np.argsort(digest[distinct])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        yield low, high, own, place[number], ghosts, digest[distinct][order]


def _blocks(docs: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    """Rows of CARRIED, and n_words, n_tokens, split (whether a row of it has another block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = row = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices_by_bytes(batch, 2, SLICE_BYTES):
                trained = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                blocks = list(_pieces(part.column(2)))
                for low, high, starts, number, ghosts, vocabulary in blocks:
                    ids = pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), part.column(0).slice(low, high - low))
                    blobs = (np.packbits(trained[low:high]).tobytes(), _put(starts.astype("<u4")), _put(number.astype("<u4")))
                    sizes = (pa.array([len(vocabulary)], pa.int64()), pa.array([len(number)], pa.int64()), pa.array([len(blocks) > 1]))
                    rows = np.arange(row + low, row + high).astype("<i8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([rows], pa.binary()), ids, *(pa.array([x], pa.binary()) for x in blobs), pa.array([ghosts], pa.int32()), pa.array([_planes(vocabulary)], pa.binary()), *sizes], names=["block", "rows", "ids", "train", "starts", "tokens", "ghosts", "vocabulary", "n_words", "n_tokens", "split"])
                    n += 1
                row += part.num_rows
        given_back()

    frame = docs.select(F.col(id_col).alias("id"), train.alias("train"), docs[text_col].cast("string").alias("text"))
    return frame.mapInArrow(run, CARRIED.format(id=docs.schema[id_col].dataType.simpleString()) + ", n_words long, n_tokens long, split boolean")


class Block:
    def __init__(self, row: dict):
        self.starts = _get(row["starts"], "<u4").astype(np.int64)
        self.n = len(self.starts) - 1
        self.tokens = _get(row["tokens"], "<u4").astype(np.int64)
        self.ghosts = row["ghosts"]
        self.train = np.unpackbits(np.frombuffer(row["train"], np.uint8))[: self.n].astype(bool)
        self.doc = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.starts))
        #: Tokens before each one in its row, as far as the block knows; of a row that goes on, at least two.
        self.before = np.arange(len(self.tokens)) - self.starts[self.doc]
        self.counted = np.arange(len(self.tokens)) >= self.ghosts
        self.trained = self.train[self.doc] & self.counted

    def pairs(self, h: np.ndarray) -> np.ndarray:
        """A digest of (context, token) by token; h: the tokens' digests."""
        context = np.concatenate([[BEGIN], h[:-1]])
        context[self.before == 0] = BEGIN
        return mixed(context * _A + h)

    def triples(self, h: np.ndarray) -> np.ndarray:
        """A digest of a token and the two before it in its row."""
        pair = self.pairs(h)
        return mixed(np.concatenate([[BEGIN], pair[:-1]]) * _B + h)


def _cut(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each digest range starts in sorted keys."""
    bounds = np.array([(i << 64) // ranges for i in range(ranges)], np.uint64)
    return np.append(np.searchsorted(keys, bounds), len(keys))


def _asked(kind: int, block: int, keys: np.ndarray, counts: np.ndarray, ranges: int) -> pa.RecordBatch:
    cut = _cut(keys, ranges)
    part = np.flatnonzero(np.diff(cut))
    blobs = [[_planes(keys[cut[p] : cut[p + 1]]) for p in part], [_put(counts[cut[p] : cut[p + 1]].astype("<u4")) for p in part]]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind), pa.int32()), pa.array(part, pa.int32()), pa.array(np.full(len(part), block), pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)], names=["kind", "part", "block", "keys", "counts"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _requests(blocks: DataFrame, ranges: tuple[int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block, vocabulary = Block(row), _from_planes(row["vocabulary"])
            yield _asked(WORDS, row["block"], vocabulary, np.bincount(block.tokens[block.trained], minlength=len(vocabulary)), ranges[WORDS])
            keys, at = np.unique(block.pairs(vocabulary[block.tokens]), return_inverse=True)
            yield _asked(PAIRS, row["block"], keys, np.bincount(at[block.trained], minlength=len(keys)), ranges[PAIRS])
        given_back()

    return blocks.select("block", "train", "starts", "tokens", "ghosts", "vocabulary").mapInArrow(run, "kind int, part int, block long, keys binary, counts binary")


def _answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """What all blocks together counted, for each block's keys in order; and the range's totals in a row without block."""
    keys = [_from_planes(x) for x in pdf["keys"]]
    counts = np.concatenate([_get(x, "<u4") for x in pdf["counts"]]).astype(np.int64)
    _, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, counts).astype(np.int64)
    cut = np.cumsum([0, *map(len, keys)])
    answers = [_put(np.minimum(total[which[a:b]], 0xFFFFFFFF).astype("<u4")) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    n = len(pdf)
    return pd.DataFrame({"kind": [key[0]] * (n + 1), "part": [key[1]] * (n + 1), "block": pd.array([*pdf["block"], None], "Int64"), "counts": [*answers, None], "total": [0] * n + [int(total.sum())], "known": [0] * n + [int((total > 0).sum())]})


ANSWERS = "kind int, part int, block long, counts binary, total long, known long"


def _answered(answers: pd.DataFrame) -> dict[int, np.ndarray]:
    return {kind: np.concatenate([_get(x, "<u4") for x in own["counts"]]) for kind, own in answers.sort_values(["kind", "part"]).groupby("kind")}


def _with_counts(key: tuple, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """A block with the counts of its words, and of the bigram that ends in each token."""
    out = blocks.drop(columns=["n_words", "n_tokens", "split"])
    row, got, none = blocks.iloc[0].to_dict(), _answered(answers), np.zeros(0, "<u4")
    block = Block(row)
    _, at = np.unique(block.pairs(_from_planes(row["vocabulary"])[block.tokens]), return_inverse=True)
    return out.assign(words=[_put(got.get(WORDS, none))], pairs=[_put(got.get(PAIRS, none)[at] if len(at) else none)])


class Counted(Block):
    """A block with counts by token: of words, of bigrams and of their contexts."""

    def __init__(self, row: dict, ends: int):
        super().__init__(row)
        self.word = _get(row["words"], "<u4").astype(np.int64)[self.tokens]
        self.pair = _get(row["pairs"], "<u4").astype(np.int64)
        #: Of contexts: the word before, and the bigram before; the begin's count is that of ends.
        self.word_before = np.concatenate([[ends], self.word[:-1]])
        self.word_before[self.before == 0] = ends
        self.pair_before = np.concatenate([[ends], self.pair[:-1]])
        self.pair_before[self.before == 0] = ends
        #: The trigram's count where it need not be asked for.
        most = np.minimum(self.pair, self.pair_before)
        self.triple = np.where(self.before == 0, self.pair, most)
        self.unsure = self.counted & (self.before > 0) & (most > 0)

    def asked(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted digests of the trigrams to ask for, the tokens that they end in, and for each of those its digest's place."""
        at = np.flatnonzero(self.unsure)
        keys, place = np.unique(self.triples(vocabulary[self.tokens])[at], return_inverse=True)
        return keys, at, place


def _more_requests(counted: DataFrame, ends: int, ranges: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Counted(row, ends)
            keys, at, place = block.asked(_from_planes(row["vocabulary"]))
            yield _asked(TRIPLES, row["block"], keys, np.bincount(place[block.trained[at]], minlength=len(keys)), ranges)
        given_back()

    return counted.drop("rows", "ids").mapInArrow(run, "kind int, part int, block long, keys binary, counts binary")


def _with_triples(ends: int):
    def run(key: tuple, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """A block with the counts of the trigrams that it asked for; it needs its vocabulary no more."""
        row = blocks.iloc[0].to_dict()
        block = Counted(row, ends)
        triple = block.triple
        if len(answers):
            _, at, place = block.asked(_from_planes(row["vocabulary"]))
            triple[at] = _answered(answers)[TRIPLES][place]
        return blocks.assign(triples=[_put(triple.astype("<u4"))]).drop(columns="vocabulary")

    return run


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0).clip(0, BUCKETS - 1)


class Model:
    """Weights by order (words, bigrams, trigrams) and bucket of the context's count, over n tokens of v words."""

    def __init__(self, n: int, v: int):
        self.n, self.v = n, v
        self.uniform = 1.0 / (v + 1)
        self.weights = np.zeros((ORDERS, BUCKETS))

    def estimates(self, block: Counted, triple: np.ndarray, less: tuple = (0,) * 6) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per order, an estimate and its context's count by token; less: what is deleted from the six counts."""
        n = np.full(len(triple), self.n)
        word, pair, three, n, word_before, pair_before = (x - y for x, y in zip((block.word, block.pair, triple, n, block.word_before, block.pair_before), less, strict=True))
        return [(x / np.maximum(c, 1), c) for x, c in ((word, n), (pair, word_before), (three, pair_before))]

    def mixed(self, estimates: list[tuple[np.ndarray, np.ndarray]], orders: int = ORDERS) -> np.ndarray:
        """The probability of each token under the shortest so many orders."""
        p = np.full(len(estimates[0][0]), self.uniform)
        for k, (f, context) in enumerate(estimates[:orders]):
            w = self.weights[k][_bucket(context)]
            p = w * f + (1 - w) * p
        return p


def em(bucket: np.ndarray, step: np.ndarray, times: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """An estimate's weights by bucket, from held-out counts by the ratio of it to the shorter ones' mixture.

    step: FINE times the ratio's binary logarithm, less than -FINE * OCTAVES where the estimate is 0.
    """
    ratio = np.where(step < -FINE * OCTAVES, 0.0, 2.0 ** (step / FINE))
    seen = np.bincount(bucket, times, BUCKETS)
    weights = np.full(BUCKETS, 0.5)
    for _ in range(rounds):
        w = weights[bucket] * ratio
        share = np.bincount(bucket, times * w / (w + 1 - weights[bucket]), BUCKETS)
        weights = (share + 0.25) / (seen + 0.5)  # half a token of prior keeps rare buckets sane
    weights[0] = 0.0  # a context that wasn't seen has no estimate
    return weights


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text), deleted_score.

    deleted_score is the score of a training text when its own counts are deleted from the model; a held-out
    text's is its score. Tokens are the lower-cased words and one end; null and empty texts have the end alone.
    Rows that are not train are held out; rows that repeat count each, with equal scores, as ties are of no
    consequence here; a null id is kept. With no training token all estimates but the uniform one are 0. Other
    columns, whatever their names, are not read; an empty table gives no rows.
    """
    id_kind = docs.schema[id_col].dataType.simpleString()
    carried = CARRIED.format(id=id_kind)
    spark = docs.sparkSession
    home = shared_folder(spark)
    with scratch(spark):  # the blocks and answers go when the counted blocks are written
        blocks = stored(_blocks(docs, train, id_col, text_col), "blocks")
        asked = blocks.agg(F.sum("n_words").alias("w"), F.sum("n_tokens").alias("t"), F.bool_or("split").alias("split")).first()
        ranges = (max(12, -(-(asked["w"] or 0) // RANGE)), max(12, -(-(asked["t"] or 0) // RANGE)))
        answers = stored(_requests(blocks, ranges).groupBy("kind", "part").applyInPandas(_answer, ANSWERS), "answers")
        sums = answers.where((F.col("kind") == WORDS) & F.col("block").isNull()).agg(F.sum("total").alias("n"), F.sum("known").alias("v")).first()
        model, ends = Model(sums["n"] or 0, sums["v"] or 0), docs.where(train).count()
        own = answers.where("block is not null").select("block", "kind", "part", "counts")
        counted = stored(blocks.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(_with_counts, f"{carried}, words binary, pairs binary"), "counted", home)
    with scratch(spark):
        more = stored(_more_requests(counted, ends, ranges[PAIRS]).groupBy("kind", "part").applyInPandas(_answer, ANSWERS), "more")
        own = more.where("block is not null").select("block", "kind", "part", "counts")
        joined = counted.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(_with_triples(ends), carried.replace(", vocabulary binary", "") + ", words binary, pairs binary, triples binary")
        joined = stored(joined, "joined", home)
    removed(spark, f"{home}/counted")

    for order in range(ORDERS):

        def held_out(batches: Iterator[pa.RecordBatch], order: int = order, model: Model = model) -> Iterator[pa.RecordBatch]:
            """How often each ratio of the order's estimate to the shorter ones' mixture occurs, by bucket, each token deleted from its counts."""
            size = 2 * FINE * OCTAVES + 2
            times = np.zeros(BUCKETS * size, np.int64)
            for row in _rows(batches):
                block = Counted(row, ends)
                estimates = model.estimates(block, _get(row["triples"], "<u4").astype(np.int64), (1,) * 6)
                f, context = (x[block.trained] for x in estimates[order])
                ratio = f / model.mixed(estimates, order)[block.trained]
                step = np.where(ratio > 0, np.round(FINE * np.log2(np.maximum(ratio, 1e-300))).clip(-FINE * OCTAVES, FINE * OCTAVES), -FINE * OCTAVES - 1).astype(np.int64)
                times += np.bincount(_bucket(context) * size + step + FINE * OCTAVES + 1, minlength=len(times))
            at = np.flatnonzero(times)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at // size), pa.array(at % size - FINE * OCTAVES - 1), pa.array(times[at])], names=["bucket", "step", "times"])

        # Bounded by buckets and steps, not by the corpus.
        table = joined.drop("rows", "ids").mapInArrow(held_out, "bucket long, step long, times long").groupBy("bucket", "step").agg(F.sum("times").alias("times")).toPandas()
        model.weights[order] = em(*(table[c].to_numpy(np.int64) for c in ("bucket", "step", "times")))
    n, v = model.n, model.v

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.drop_columns(["ids"]).slice(k, 1).to_pylist()[0]
                block = Counted(row, ends)
                triple = _get(row["triples"], "<u4").astype(np.int64)
                whole = np.log10(model.mixed(model.estimates(block, triple)))
                deleted = np.log10(model.mixed(model.estimates(block, triple, _own_counts(block))))
                base = np.log10((block.word + 0.5) / (n + 0.5 * (v + 1)))
                sums = [np.bincount(block.doc[block.counted], x[block.counted], block.n) for x in (base, whole, deleted)]
                sizes, known = (np.bincount(block.doc[x], minlength=block.n).astype(np.int64) for x in (block.counted, block.counted & (block.word > 0)))
                ids = batch.column(batch.schema.get_field_index("ids"))[k].values
                rows = np.frombuffer(row["rows"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(rows), ids, pa.array(~block.train), pa.array(sizes), pa.array(known), *(pa.array(x) for x in sums)], names=["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "deleted_score"])
        given_back()

    out = joined.mapInArrow(scored, f"row long, id {id_kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, deleted_score double")
    sums = ("n_tokens", "n_known", "base_score", "score", "deleted_score")
    if asked["split"]:
        out = out.groupBy("row").agg(F.any_value("id").alias("id"), F.any_value("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in sums))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "deleted_score")


def _own_counts(block: Counted) -> tuple[np.ndarray, ...]:
    """By token, how often its own row is in the six counts: not at all unless it is trained on; a begin is had once."""
    doc = block.doc.astype(np.int64)
    begin = block.before == 0

    def times(number: np.ndarray) -> np.ndarray:
        _, at = np.unique((doc << 32) | number, return_inverse=True)
        return np.bincount(at[block.counted], minlength=len(at))[at]

    def after(number: np.ndarray) -> np.ndarray:
        """The distinct pairs of what stands before and a token, numbered."""
        last = np.concatenate([[0], number[:-1] + 1])
        last[begin] = 0
        return np.unique((last << 32) | block.tokens, return_inverse=True)[1]

    pairs = after(block.tokens)
    word, pair, triple = times(block.tokens), times(pairs), times(after(pairs))
    n = np.bincount(block.doc[block.counted], minlength=block.n)[block.doc]
    word_before, pair_before = (np.concatenate([[1], x[:-1]]) for x in (word, pair))
    word_before[begin] = pair_before[begin] = 1
    return tuple(np.where(block.train[block.doc], x, 0) for x in (word, pair, triple, n, word_before, pair_before))
