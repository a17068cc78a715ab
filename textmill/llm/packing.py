"""Order-preserving packing of tokenised documents into fixed windows by dynamic programming.

Documents keep their order. Their token streams are laid end to end and cut into windows of at most
`window` tokens. f(j) = min over i in [j - window, j) of f(i) + padding(j - i) + penalty(j) over the
candidate cuts: a document's end costs nothing, a sentence's end little, any other place more. As
padding(j - i) = window - (j - i), the minimum of f(i) + i over a sliding range of cuts is kept in a
monotone queue, so a transition takes amortised constant time; windows whose length is a power of two
need no padding and are tried beside it.
"""

from __future__ import annotations

import base64
import itertools
import json
import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm._common import encoded, given_back, of_stage, ranged, slices_by_bytes, text_bytes

DOCUMENT, SENTENCE, ANYWHERE = 0.0, 2.0, 12.0  # penalties of a cut
OPENING = 8.0  # cost of a sequence besides its padding
STEP = 64  # a candidate cut lies within so many tokens of the one before
BLOCK = 1 << 17  # tokens that are cut together; the last window of a block is open and goes on in the next
LEAST_POWER = 64
SLICE = 1 << 20  # bytes of text that are encoded together


def best_cuts(places: np.ndarray, penalties: np.ndarray, window: int, final: bool) -> list[int]:
    """Indexes into the ascending places (the first is the start, the last the end of the stream) of the best cuts.

    No two neighbouring places may lie further apart than the window. Without final, the last window isn't padded.
    """
    x, cost = places.tolist(), penalties.tolist()
    n = len(x)
    f, back = [0.0] * n, [0] * n
    powers = [1 << k for k in range(window.bit_length()) if LEAST_POWER <= 1 << k < window]
    at = {x[0]: 0}
    queue: deque[tuple[float, int]] = deque([(float(x[0]), 0)])
    last = n - 1
    for j in range(1, n):
        here = x[j]
        while x[queue[0][1]] < here - window:
            queue.popleft()
        if j == last and not final:
            best, i = min((f[i], i) for i in range(j) if x[i] >= here - window)
        else:
            best, i = queue[0]
            best += window - here
            for p in powers:
                k = at.get(here - p)
                if k is not None and f[k] < best:
                    best, i = f[k], k
        f[j], back[j] = best + cost[j] + OPENING, i
        at[here] = j
        value = f[j] + here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


class UnitTokenizer:
    """Token ids of whole texts by a byte-level BPE, each distinct unit of a batch encoded once.

    A unit ends before a space that follows a character other than white space. The byte-level pattern has
    no alternative that holds such a pair (a space stands only at a token's start or within white space),
    so the ids of a text are those of its units in a row; a space after white space stays in its unit.
    Plain units may be encoded from the same vocabulary's ranks, which is faster, if the file's merges are
    those ranks (same_merges); units with a bar (the special token's string has some) or with other than
    Latin letters are left to the tokenizer.
    """

    def __init__(self, file: str, ranks_file: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.ranks = None
        if ranks_file:
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if ranks_file and same_merges(file, ranks):
            self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.width = np.zeros(max(ranks.values()) + 1, np.int64)
            self.width[list(ranks.values())] = [len(x) for x in ranks]
        self.odd = np.ones(256, bool)  # bytes that plain units lack
        self.odd[[9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = False
        self.odd[ord("|")] = True
        self.blank = np.zeros(256, bool)
        self.blank[:0x21] = True

    def units(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where units start, rows' starts included."""
        at = np.flatnonzero(data == 0x20)
        at = at[at > 2]
        wide = data[at - 3]
        at = at[~self.blank[data[at - 1]] & ~((data[at - 1] >= 0x80) & ((data[at - 2] == 0xC2) | (wide >= 0xE1) & (wide <= 0xE3)))]
        marked = np.zeros(len(data), bool)
        marked[at] = True
        marked[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(marked)

    def encode(self, column: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per text: its ids with the end id, and the token offsets after sentences."""
        data, offsets = text_bytes(column)
        starts = self.units(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        which, units = encoded(data, np.append(starts, len(data)) if len(starts) else np.zeros(1, np.int64))
        own, bounds = text_bytes(units)
        a, n = bounds[:-1], np.diff(bounds)
        odd = np.concatenate([[0], np.cumsum(self.odd[own])])
        plain = (odd[a + n] == odd[a]) & (own[a] == 0x20) if self.ranks and len(a) else np.zeros(len(a), bool)
        k = np.flatnonzero(plain)
        flat = np.array(self.ranks.encode_ordinary(ranged(own, a[k], n[k]).tobytes().decode()) if len(k) else [], np.uint32)
        sizes = np.zeros(len(a), np.int64)
        sizes[k] = np.diff(np.searchsorted(np.cumsum(self.width[flat]), np.cumsum(n[k])) + 1, prepend=0) if len(k) else 0
        rest = np.flatnonzero(~plain)
        begin = np.zeros(len(a), np.int64)
        begin[k] = np.cumsum(sizes[k]) - sizes[k]
        parts, m = [flat], len(flat)
        for at in range(0, len(rest), 512):
            part = rest[at : at + 512]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([own[a[i] : a[i] + n[i]].tobytes().decode() for i in part], add_special_tokens=False), strict=True):
                parts.append(np.array(e.ids, np.uint32))
                begin[i], sizes[i] = m, len(e.ids)
                m += len(e.ids)
        flat = np.concatenate(parts)
        ids = ranged(flat, begin[which], sizes[which])
        after = np.cumsum(sizes[which])
        last, break_line = data[ends - 1], np.concatenate([[0], np.cumsum(data == 0x0A)])
        closing = np.isin(last, _CLOSING) | (break_line[ends] > break_line[starts])
        rows = np.searchsorted(starts, offsets)
        token = np.concatenate([[0], after])[rows]
        end = np.array([end_id], np.uint32)
        for i in range(len(offsets) - 1):
            own = slice(rows[i], rows[i + 1])
            yield np.concatenate([ids[token[i] : token[i + 1]], end]), after[own][closing[own]] - token[i]


def same_merges(file: str, ranks: dict[bytes, int]) -> bool:
    """Whether a byte-level BPE file has these tokens, and merges in the order of the ranks."""
    with open(file) as f:
        data = json.load(f)
    if data["normalizer"] or data["model"]["type"] != "BPE" or data["pre_tokenizer"]["type"] != "ByteLevel":
        return False
    # The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for characters from U+0100 on.
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}
    special = {t["content"] for t in data["added_tokens"]}
    vocabulary = {bytes(byte_of[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
    ids = [data["model"]["vocab"][a + b] for a, b in merges]
    return vocabulary == ranks and all(x < y for x, y in itertools.pairwise(ids)) and len(ids) == sum(len(t) > 1 for t in ranks)


def _tokenizer(file: str | None) -> UnitTokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if file is None:
        import public_tokenizers as public

        return UnitTokenizer(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    return UnitTokenizer(file)


_CLOSING = [ord(x) for x in ".!?"]


class Packer:
    """Takes documents in order and gives pieces (document, start, length, crc32, tokens, sequence, offset)."""

    def __init__(self, window: int):
        self.window = window
        self.sequence = 0
        self.docs: deque[tuple[object, int, np.ndarray, np.ndarray]] = deque()  # key, ids given before, all ids, sentence ends
        self.tokens = 0

    def add(self, key, ids: np.ndarray, sentences: np.ndarray) -> Iterator[tuple]:
        self.docs.append((key, 0, ids, sentences))
        self.tokens += len(ids)
        if self.tokens >= BLOCK:
            yield from self.flush(False)

    def flush(self, final: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        sizes = np.array([len(ids) - done for _, done, ids, _ in self.docs], np.int64)
        ends = np.cumsum(sizes)
        marked = np.zeros(self.tokens + 1, bool)
        sentences = np.concatenate([own[own > done] + (at - done) for (_, done, _, own), at in zip(self.docs, ends - sizes, strict=True)])
        marked[sentences] = True
        marked[ends] = True
        marked[0] = True
        marks = np.flatnonzero(marked)
        fills = (np.diff(marks) - 1) // STEP
        filled = np.repeat(marks[:-1], fills) + STEP * (np.arange(fills.sum()) - np.repeat(np.cumsum(fills) - fills, fills) + 1)
        places = np.sort(np.concatenate([marks, filled]))
        costs = np.full(len(places), ANYWHERE)
        costs[np.searchsorted(places, sentences)] = SENTENCE
        costs[np.searchsorted(places, ends)] = DOCUMENT
        cuts = places[best_cuts(places, costs, self.window, final)]
        if not final:
            cuts = cuts[:-1]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield from self.take(int(b - a))

    def take(self, length: int) -> Iterator[tuple]:
        offset = 0
        while offset < length:
            key, done, ids, sentences = self.docs.popleft()
            n = min(length - offset, len(ids) - done)
            yield key, done, n, zlib.crc32(ids[done : done + n].astype("<u4").tobytes()), len(ids), self.sequence, offset
            if done + n < len(ids):
                self.docs.appendleft((key, done + n, ids, sentences))
            offset += n
            self.tokens -= n
        self.sequence += 1


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, tokenizer_file: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of packed sequences: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are dealt by ranges of their id, so a sequence holds neighbours in id order; each range is
    packed by itself in one streaming pass that holds one block of tokens. Only the last sequence of a range
    can end early. Null and empty texts are documents of the end id alone; null ids come first; rows with
    equal ids are packed each; an empty table gives no pieces; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, packer = of_stage(_tokenizer, tokenizer_file), Packer(window)
        shard = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            key, start, length, crc, total, sequence, offset = zip(*rows, strict=True)
            sequences = pa.array([shard + s for s in sequence], pa.int64())
            arrays = [pa.array(key, kind), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), sequences, pa.array(offset, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for part in slices_by_bytes(batch, 1, SLICE):
                for key, (ids, sentences) in zip(part.column(0).to_pylist(), tokenizer.encode(part.column(1), end_id), strict=True):
                    rows.extend(packer.add(key, ids, sentences))
                if len(rows) >= 4096:
                    yield batch_of(rows)
                    rows = []
        rows.extend(packer.flush(True))
        if rows:
            yield batch_of(rows)
        given_back()

    frame = docs.select(id_col, docs[text_col].cast("string").alias("_text")).repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return frame.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
