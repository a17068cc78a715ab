"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments, each the postings of a few megabytes of whole documents: sorted term
digests (128 bits a word) and, per term, its ascending word positions in the segment. No term's postings are ever gathered
in one place, so frequent terms need no special care. A phrase is found in a segment by taking the
positions of its rarest term there, shifting them by the term's place in the phrase, and intersecting
with the other terms' lists, rarer ones first; most phrases end at a term that the segment lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm._common import Words, given_back, slices_by_bytes
from textmill.shared import stored

WINDOW = 10
SEGMENT_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20  # of phrases that are sent to the segments at once

INDEX = "segment long, row_ids array<{id}>, row_starts binary, terms binary, checks binary, firsts binary, positions binary"


def ranked(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The digests of the distinct words, ascending, and by word its place among them."""
    digest = words.digests()
    order = np.lexsort((digest[:, 1], digest[:, 0]))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    return np.ascontiguousarray(digest[order]), place[words.number]


def postings(column: pa.Array) -> tuple[np.ndarray, ...]:
    """A segment of these texts: row starts, terms, checks, firsts, positions."""
    words = Words(column, "alnum")
    term, number = ranked(words)
    positions = np.argsort(number, kind="stable").astype("<i4")
    first = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(term)))])
    return words.rows.astype("<i4"), np.ascontiguousarray(term[:, 0]), np.ascontiguousarray(term[:, 1]), first.astype("<i4"), positions


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index's segments (see INDEX), for writing as a table. All words of all rows are in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices_by_bytes(batch, 1, segment_bytes):
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), ids, *(pa.array([x.tobytes()], pa.binary()) for x in postings(part.column(1)))], names=["segment", "row_ids", "row_starts", "terms", "checks", "firsts", "positions"])
                n += 1
        given_back()

    frame = docs.select(id_col, docs[text_col].cast("string").alias("_text"))
    return frame.mapInArrow(run, INDEX.format(id=docs.schema[id_col].dataType.simpleString()))


class Segment:
    """One segment, opened for the terms of a set of phrases only."""

    def __init__(self, row_starts: bytes, terms: bytes, checks: bytes, firsts: bytes, positions: bytes, wanted: np.ndarray):
        self.rows = np.frombuffer(row_starts, "<i4").astype(np.int64)
        have, check, first = np.frombuffer(terms, "<u8"), np.frombuffer(checks, "<u8"), np.frombuffer(firsts, "<i4").astype(np.int64)
        at = np.searchsorted(have, wanted[:, 0])
        there = at < len(have)
        there[there] = (have[at[there]] == wanted[there, 0]) & (check[at[there]] == wanted[there, 1])
        at = at[there]
        self.size = np.zeros(len(wanted), np.int64)
        self.size[there] = first[at + 1] - first[at]
        all_positions = np.frombuffer(positions, "<i4")
        lists = [all_positions[a:b] for a, b in zip(first[at], first[at + 1], strict=True)]
        own = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.positions = own
        self.keys = (np.repeat(np.arange(len(wanted)), self.size) << 32) | own  # ascending: by term, then position

    def row_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.rows, position, "right") - 1

    def phrases(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (phrase, position) of phrases, given as rows of term numbers of one length."""
        n = phrases.shape[1]
        order = np.argsort(self.size[phrases], axis=1, kind="stable")  # rarest first
        which = np.flatnonzero(self.size[phrases].min(axis=1) > 0)
        rarest = phrases[which, order[which, 0]]
        sizes = self.size[rarest]
        ends = np.cumsum(sizes)
        inside = np.repeat(self.first[rarest] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        which = np.repeat(which, sizes)
        start = self.positions[inside] - order[which, 0]
        keep = start >= 0
        which, start = which[keep], start[keep]
        for k in range(1, n):
            if not len(which):
                break
            place = order[which, k]
            key = (phrases[which, place] << 32) | (start + place)
            at = np.searchsorted(self.keys, key)
            keep = at < len(self.keys)
            keep[keep] = self.keys[at[keep]] == key[keep]
            which, start = which[keep], start[keep]
        same = self.row_of(start) == self.row_of(start + n - 1)
        return which[same], start[same]

    def near(self, phrase: np.ndarray, span: int) -> np.ndarray:
        """Positions of the phrase's rarest term that have each other term within span words in the same row."""
        order = phrase[np.argsort(self.size[phrase], kind="stable")]
        if not self.size[order[0]]:
            return np.zeros(0, np.int64)
        anchor = self.positions[self.first[order[0]] : self.first[order[0]] + self.size[order[0]]]
        for term in order[1:]:
            row = self.row_of(anchor)
            low, high = np.maximum(anchor - span, self.rows[row]), np.minimum(anchor + span, self.rows[row + 1] - 1)
            a, b = np.searchsorted(self.keys, (term << 32) | low), np.searchsorted(self.keys, (term << 32) | high, "right")
            anchor = anchor[b > a]
        return anchor


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """The stated set of items in blocks of bounded size, one at a time, and their number. Null ids or texts take no part."""
    frame = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    total = frame.select(F.sum(F.octet_length("t") + 16).alias("n")).first()["n"] or 0
    n = -(-total // block_bytes)
    return n, ([(r["i"], r["t"]) for r in (frame.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else frame).collect()] for k in range(n))


def windows(block: list[tuple[str, str]], size: int) -> tuple[list[str], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Item ids; all terms; and per length the windows (as rows of term numbers) with their items' numbers.

    An item of fewer words than size, but not none, is one window.
    """
    ids = sorted({i for i, _ in block})
    number = {i: k for k, i in enumerate(ids)}
    words = Words(pa.array([t for _, t in block], pa.string()), "alnum")
    rows, (terms, term) = words.rows, ranked(words)
    term = term.astype(np.int64)  # keys of terms and positions are made of it
    by_length: dict[int, tuple[list, list]] = {}
    for k, (i, _) in enumerate(block):
        own = term[rows[k] : rows[k + 1]]
        if len(own):
            n = min(size, len(own))
            grams, whose = by_length.setdefault(n, ([], []))
            grams.append(np.lib.stride_tricks.sliding_window_view(own, n))
            whose.append(np.full(len(own) - n + 1, number[i]))
    return ids, terms, [(np.concatenate(g), np.concatenate(w)) for _, (g, w) in sorted(by_length.items())]


def phrase_hits(index: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per indexed row: id, n_words, the positions hit by any item's window, and the items' ids as strings.

    Several blocks of items are searched one after another, and what each finds is stored, so the driver holds
    the windows of one block.
    """
    kind = index.schema["row_ids"].dataType.elementType.simpleString()
    schema = f"segment long, row int, `{id_col}` {kind}, n_words long, hits array<int>, items array<string>"
    n, blocks = item_blocks(items, item_id, item_text, block_bytes)
    if n <= 1:
        given = windows(next(blocks), window) if n else ([], np.zeros((0, 2), np.uint64), [])
        return index.mapInArrow(_search(given, schema, id_col, kind), schema).drop("segment", "row")
    found = None
    for block in blocks:
        part = index.mapInArrow(_search(windows(block, window), schema, id_col, kind), schema)
        part = stored(part.where(F.size("items") > 0).select("segment", "row", "hits", "items"), "hits")
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("segment", "row").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    every = index.mapInArrow(_search(([], np.zeros((0, 2), np.uint64), []), schema, id_col, kind), schema).drop("hits", "items")
    both = every.join(found, ["segment", "row"], "left")
    return both.select(id_col, "n_words", *(F.coalesce(c, F.array().cast(f"array<{k}>")).alias(c) for c, k in (("hits", "int"), ("items", "string"))))


def _search(given, schema: str, id_col: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, lengths = given
        for batch in batches:
            for k in range(batch.num_rows):
                blobs = [batch.column(j)[k].as_py() for j in range(2, 7)]
                segment = Segment(*blobs, terms)
                n = len(segment.rows) - 1
                hit, pairs = np.zeros(segment.rows[-1] + 1, bool), []
                for grams, whose in lengths:
                    which, start = segment.phrases(grams)
                    for j in range(grams.shape[1]):
                        hit[start + j] = True
                    pairs.append(np.stack([segment.row_of(start), whose[which]]))
                row, item = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
                at = np.flatnonzero(hit)
                whose = segment.row_of(at)
                bounds = np.arange(n + 1)
                hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, bounds), pa.int32()), pa.array(at - segment.rows[whose], pa.int32()))
                found = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, bounds), pa.int32()), pa.array([ids[i] for i in item], pa.string()))
                number = pa.array(np.full(n, batch.column(0)[k].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([number, pa.array(np.arange(n), pa.int32()), batch.column(1)[k].values, pa.array(np.diff(segment.rows), pa.int64()), hits, found], names=["segment", "row", id_col, "n_words", "hits", "items"])
        given_back()

    return run


def judged(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, segment_bytes: int = SEGMENT_BYTES, block_bytes: int = BLOCK_BYTES) -> Column | None:
    """Whether a text has any window of an item; None if the items take several blocks, whose windows must not lie in memory together.

    Each segment is searched where it is made, and nothing of the index is stored. Each text is judged by
    itself, whole, so repeated rows get equal answers. No items: nothing is contaminated.
    """
    n, blocks = item_blocks(items, item_id, item_text, block_bytes)
    if not n:
        return F.lit(False)
    if n > 1:
        return None
    box = docs.sparkSession.sparkContext.broadcast(windows(next(blocks), window)[1:])  # of one block

    @F.arrow_udf("boolean")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        given_back()
        terms, lengths = box.value
        for column in columns:
            bad, at = np.zeros(len(column), bool), 0
            for part in slices_by_bytes(pa.record_batch([column], ["text"]), 0, segment_bytes):
                segment = Segment(*postings(part.column(0)), terms)
                for grams, _ in lengths:
                    bad[at + segment.row_of(segment.phrases(grams)[1])] = True
                at += part.num_rows
            yield pa.array(bad)
        given_back()

    return run.asNondeterministic()(F.col(text_col).cast("string"))  # so that the planner doesn't run it twice


def proximity_hits(index: DataFrame, items: DataFrame, span: int, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs (id, item, matches): rows where each of an item's words stands within span words of its rarest one."""
    kind = index.schema["row_ids"].dataType.elementType.simpleString()
    schema = f"`{id_col}` {kind}, item string, matches long"
    out = index.sparkSession.createDataFrame([], schema)
    for block in item_blocks(items, item_id, item_text, block_bytes)[1]:

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            words = Words(pa.array([t for _, t in block], pa.string()), "alnum")
            terms, number = ranked(words)
            given = [(i, np.unique(number[a:b]).astype(np.int64)) for (i, _), a, b in zip(block, words.rows[:-1], words.rows[1:], strict=True)]
            for batch in batches:
                for k in range(batch.num_rows):
                    segment, ids = Segment(*(batch.column(j)[k].as_py() for j in range(2, 7)), terms), batch.column(1)[k].values
                    for item, words in given:
                        if len(words):
                            row, n = np.unique(segment.row_of(segment.near(words, span)), return_counts=True)
                            if len(row):
                                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array([item] * len(row)), pa.array(n, pa.int64())], names=[id_col, "item", "matches"])

        out = out.unionByName(index.mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated; the index is stored and read again.

    Null and empty texts have no words. Items without words, and null item ids, take no part; items that
    repeat an id count once. Repeated documents are reported each. No items: nothing is contaminated.
    """
    index = stored(build_index(docs, id_col, text_col), "phrase_index")
    hits = phrase_hits(index, items, item_id, item_text, id_col, window)
    n_hit = F.size("hits").cast("long")
    return hits.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
