"""Helpers that the operators of this package share: words of whole columns, byte slices, thinned samples."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def thinned(df: DataFrame, hash_col: str, rows: int) -> DataFrame:
    """About one and a half times as many rows as are wanted, by a bound on their hashes, before the smallest are taken.

    For fitting on a bounded sample: else every task would send its own smallest rows.
    """
    bits = 1 << 30
    share = min(1.0, (1.5 * rows + 20) / max(1, df.count()))
    return df.where(F.pmod(F.col(hash_col), F.lit(bits)) < int(share * bits) + 1)


# ---------------------------------------------------------------------------------------------
# Words. Equal words of a column are found by their bytes; between blocks and tasks a word is known
# by its BLAKE2b digest, as 64 or 128 bits, so no two words share one by their form.


def separators(kind: str) -> np.ndarray:
    """By byte: true where it separates words. space: ASCII white space; alnum: all ASCII but letters and digits."""
    out = np.zeros(256, bool)
    if kind == "space":
        out[[0x20, *range(0x09, 0x0E)]] = True
    elif kind == "alnum":
        out[:128] = [not chr(i).isalnum() for i in range(128)]
    else:
        raise ValueError(kind)
    return out


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_separators = {k: separators(k) for k in ("space", "alnum")}
CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and the offsets of its rows."""
    if column.type != pa.large_binary():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("" if column.type == pa.large_string() else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def encoded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Byte ranges that lie end to end: the number of each among the distinct ones, and those."""
    ranges = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    out = ranges.dictionary_encode()
    return out.indices.to_numpy(), out.dictionary


def _pieces(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of about CHUNK bytes that end where a row or a word does."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + CHUNK)
        if to < n:
            row = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if row > at:
                to = row
            else:
                end = int(offsets[np.searchsorted(offsets, at, "right")])  # of the row that at lies in
                back = np.flatnonzero(sep[data[at + CHUNK // 2 : to]])
                if len(back):
                    to = at + CHUNK // 2 + int(back[-1]) + 1
                else:
                    while to < end and not (found := np.flatnonzero(sep[data[to : min(end, to + CHUNK)]])).size:
                        to = min(end, to + CHUNK)
                    to = to + int(found[0]) if to < end else end
        yield at, to
        at = to


class Words:
    """The lower-cased words (A-Z as a-z) of a column: by word its number among the distinct ones, and rows' offsets."""

    def __init__(self, column: pa.Array, kind: str):
        data, offsets = text_bytes(column)
        sep = _separators[kind]
        counts = np.zeros(len(offsets) - 1, np.int64)
        numbers, own = [], []
        for a, b in _pieces(data, offsets, sep):
            part = _FOLD[data[a:b]]
            inside = ~sep[part]
            low, high = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")  # rows low .. high - 1
            bounds = np.clip(offsets[low : high + 1] - a, 0, b - a)
            inner = bounds[(bounds > 0) & (bounds < len(part))]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            begins[inner] = inside[inner]  # words never run from one row into the next
            first = np.flatnonzero(begins)
            counts[low:high] += np.diff(np.searchsorted(first, bounds))
            if len(first):
                letters = np.cumsum(inside)  # letters up to each byte
                number, distinct = encoded(part[inside], np.append(letters[first] - 1, letters[-1]))
                numbers.append(number)
                own.append(distinct)
        self.rows = np.concatenate([[0], np.cumsum(counts)])
        if len(own) > 1:
            again = pa.concat_arrays(own).dictionary_encode()
            renumbered, at = again.indices.to_numpy(), 0
            for k, distinct in enumerate(own):
                numbers[k] = renumbered[at : at + len(distinct)][numbers[k]]
                at += len(distinct)
            own = [again.dictionary]
        self.number = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        self.distinct: pa.Array = own[0] if own else pa.array([], pa.large_binary())

    def digests(self) -> np.ndarray:
        """Two 64-bit values by distinct word."""
        return digests(self.distinct)


SHORT = 16  # bytes of a word that two values hold whole


def digests(words: pa.Array) -> np.ndarray:
    """Two 64-bit values by word: of up to SHORT bytes a mixing of these, which keeps them apart, else of its BLAKE2b digest."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    size, data = np.diff(offsets), np.frombuffer(words.buffers()[2], np.uint8) if len(words) and words.buffers()[2] else np.zeros(0, np.uint8)
    out = np.zeros((len(words), 2), "<u8")
    short = np.flatnonzero(size <= SHORT)
    padded = np.zeros(len(short) * SHORT, np.uint8)
    n = size[short]
    padded[ranged(np.arange(len(padded)), np.arange(len(short)) * SHORT, n)] = ranged(data, offsets[:-1][short], n)
    a, b = padded.view("<u8").reshape(-1, 2).T
    n = n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out[short, 0] = mixed(mixed(a + n) ^ (b * np.uint64(0xD6E8FEB86659FD93)))
    out[short, 1] = mixed(mixed(b + n) ^ (a * np.uint64(0xC2B2AE3D27D4EB4F)))
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = np.frombuffer(blake2b(data[offsets[i] : offsets[i + 1]], digest_size=16).digest(), "<u8")
    return out


def word_digests(words: list[bytes]) -> np.ndarray:
    return digests(pa.array(words, pa.large_binary()))


def slices_by_bytes(batch: pa.RecordBatch, column: int, most: int = 4 << 20):
    """Slices of a batch whose text takes about so many bytes; one row at least."""
    if not batch.num_rows:
        return
    text = batch.column(column)
    size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, done + most, "right")))
        yield batch.slice(at, to - at)
        at, done = to, size[to - 1]


def ranged(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The elements of ranges, one range after another."""
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


_held: dict = {}


def of_stage(make=None, *given):
    """make(*given), kept in this worker for its tasks of one Spark stage; nothing of an earlier stage stays."""
    from pyspark import TaskContext

    context = TaskContext.get()
    stage = context.stageId() if context else None
    if _held.get("stage", stage) != stage:
        _held.clear()
    _held["stage"] = stage
    if make is None:
        return None
    if (make, given) not in _held:
        _held[make, given] = make(*given)
    return _held[make, given]


def given_back() -> None:
    """Returns what a task has freed to the system, as the next stage's tasks run in the same workers."""
    of_stage()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries
        pass
