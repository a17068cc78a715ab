"""Token counts of whole documents by overlap resynchronisation.

A text is encoded in overlapping chunks. Two neighbouring chunks are spliced at a position of their
overlap that is proven stable: no piece of the vocabulary holds the two characters on its sides next
to each other, so no merge, in any context, can run across it, and every encoding has a token border
there. Both encodings' offsets are checked for that border; where an overlap holds none, it is widened.

The proof needs a tokenizer whose normaliser is the identity (white space to U+2581, one prefix space).
Others are encoded whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from textmill.llm._common import given_back, of_stage, slices_by_bytes

SLICE = 1 << 20  # bytes of texts that are counted together
RUN = 4096  # chunks that are encoded together
SPACE = "▁"


class ResyncCounter:
    """Counts tokens of texts; chunk and overlap are in characters."""

    def __init__(self, model_file: str, chunk: int = 480, overlap: int = 20):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.encoder = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk, overlap
        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        self.sound = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces and model.trainer_spec.model_type == model.trainer_spec.BPE
        pieces = [(p.piece, p.type == p.BYTE) for p in model.pieces]
        #: Bytes of normalised text that a token stands for.
        self.width = np.array([1 if byte else len(p.encode()) for p, byte in pieces], np.int64)
        self.joined = {a + b for p, byte in pieces if not byte for a, b in zip(p, p[1:], strict=False)}
        self.widened = 0

    def stable(self, text: str, low: int, high: int) -> int:
        """The last proven border strictly between low and high; -1 if there is none."""
        for i in range(high - 1, low, -1):
            a, b = text[i - 1], text[i]
            if (SPACE if a == " " else a) + (SPACE if b == " " else b) not in self.joined:
                return i
        return -1

    def plan(self, text: str) -> tuple[list[tuple[int, int]], list[int]]:
        """Chunks (from, to) of a text and, between neighbours, the borders where they are spliced."""
        n = len(text)
        chunks, borders, start = [], [], 0
        while n - start > self.chunk + self.overlap:
            following, overlap = start + self.chunk, self.overlap
            while True:
                end = min(n, following + overlap)
                border = self.stable(text, following, end)
                if border >= 0 or end == n:
                    break
                overlap *= 2
                self.widened += 1
            if border < 0:
                break  # up to the end no border is proven: the last chunk takes the rest
            chunks.append((start, end))
            borders.append(border)
            start = following if overlap == self.overlap else border - 1
        chunks.append((start, n))
        return chunks, borders

    @staticmethod
    def length(text: str) -> int:
        """Bytes of the normalised text, without the prefix."""
        return len(text.encode()) + 2 * text.count(" ")

    def counts(self, texts: list[str]) -> list[int]:
        if not self.sound:
            return [len(x) for x in self.encoder.encode(texts, num_threads=1)]
        plans = [self.plan(t) for t in texts]
        # Long texts are counted in runs of chunks; two runs share a chunk, whose tokens are then taken off once.
        runs = [(k, chunks[at : at + RUN + 1], borders[at : at + RUN]) for k, (chunks, borders) in enumerate(plans) for at in range(0, max(1, len(borders)), RUN)]
        out, bad, at = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool), 0
        while at < len(runs):
            to, n = at, 0
            while to < len(runs) and (to == at or n + len(runs[to][1]) <= RUN):
                n += len(runs[to][1])
                to += 1
            for (k, chunks, _), (tokens, last, wrong) in zip(runs[at:to], self._run(texts, runs[at:to]), strict=True):
                out[k] += tokens - (last if chunks[-1] != plans[k][0][-1] else 0)
                bad[k] |= wrong
            at = to
        for i in np.flatnonzero(bad):  # cannot be, by the proof; such a text is encoded whole
            out[i] = len(self.encoder.encode(texts[i]))
        return out.tolist()

    def _run(self, texts: list[str], runs: list[tuple]) -> Iterator[tuple[int, int, bool]]:
        """Per run of chunks: its tokens, those of its last chunk from its start on, and whether a border failed."""
        ids = self.encoder.encode([texts[t][a:b] for t, chunks, _ in runs for a, b in chunks], num_threads=1)
        sizes = np.array([len(x) for x in ids], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])  # each chunk's first token among all
        ends = np.cumsum(self.width[np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(first[-1]))])
        begins = np.concatenate([[0], ends])[first[:-1]]  # normalised bytes before each chunk
        left, offsets, follow, k = [], [], [], 0
        for t, chunks, borders in runs:
            for i, border in enumerate(borders):
                left.append(k + i)
                offsets.append(self.length(texts[t][chunks[i][0] : border]))
                follow.append(self.length(texts[t][chunks[i + 1][0] : border]))
            k += len(chunks)
        left = np.array(left, np.int64)
        cut, ok = self.border(ends, begins[left] + 3 + np.array(offsets, np.int64))
        again, fine = self.border(ends, begins[left + 1] + 3 + np.array(follow, np.int64))
        spliced = np.zeros(len(ids) + 1, np.int64)  # of each chunk: its tokens less those that a neighbour counts
        spliced[: len(ids)] = sizes
        np.subtract.at(spliced, left, first[left + 1] - cut)
        np.subtract.at(spliced, left + 1, again - first[left + 1])
        bad = np.zeros(len(ids) + 1, bool)
        bad[left] = ~(ok & fine)
        at = 0
        for _, chunks, _ in runs:
            to = at + len(chunks)
            yield int(spliced[at:to].sum()), int(sizes[to - 1]), bool(bad[at:to].any())
            at = to

    @staticmethod
    def border(ends: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens end by each offset, and whether one ends exactly there."""
        i = np.searchsorted(ends, offsets)
        there = i < len(ends)
        there[there] = ends[i[there]] == offsets[there]
        return i + 1, there


def _counter(model_file: str | None, chunk: int, overlap: int) -> ResyncCounter:
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path("piece_bpe_32k.model")
    return ResyncCounter(model_file, chunk, overlap)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None, limit: int = 4096, chunk: int = 480, overlap: int = 20) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens; a null id stays null; repeated rows are counted
    each; other columns, whatever their names, are not read. One narrow pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = of_stage(_counter, model_file, chunk, overlap)
        for batch in batches:
            for part in slices_by_bytes(batch, 1, SLICE):
                texts = [x or "" for x in part.column(1).to_pylist()]
                n = np.array(counter.counts(texts), np.int64)
                sizes = pc.fill_null(pc.cast(pc.binary_length(part.column(1)), pa.int64()), 0)
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])
        given_back()

    frame = docs.select(id_col, docs[text_col].cast("string").alias("_text"))
    return frame.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
