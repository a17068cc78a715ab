"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text accepts exactly the strings that occur in it. A text is
parsed greedily into the longest phrases that each automaton accepts (cross parsing); the language that
needs the fewest phrases per character, normalised by the logarithm of its training length, wins. A letter
that a language doesn't know is a phrase, too, and costs a literal besides.

The automata are turned into tables: state x character class -> next state, with the number of phrases that
end there. So all texts of a batch advance together, a character of each per step, in vector operations. A
table has the classes of its own language's sample; beyond DENSE_CELLS its transitions are sorted keys
instead, which give the same states.

Characters become classes: each letter of the samples has its own (upper case as lower case), letters that
no sample has share one, which no automaton knows, all else is one separator, runs of which count once.

Long texts are parsed in segments side by side, each as if a phrase began with it. Then each segment is parsed
again from the state that the one before ends in, beside the first parse, until both are in one state, from
where on they agree; so the phrases are those of one parse of the whole text.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm._common import given_back, slices_by_bytes

SAMPLE_DOCS = 400  # labelled documents per language that the automata learn from
SAMPLE_CHARS = 40_000  # characters per language
ALL_CHARS = 20_000_000  # of all languages' samples: with more than 500 languages each has a smaller share
MOST_SENT = 100_000  # languages up to which their bounds are sent to all tasks
SEGMENT = 1 << 11
DENSE_CELLS = 1 << 24  # cells of all dense tables together
SLICE = 4 << 20  # bytes of text that are parsed together
LITERAL = 20  # bits that a letter costs besides its phrase where a language doesn't know it: it is to be spelled
SEPARATOR, OTHER = 0, 1
ENDED = 29  # the bit from which on a table's entry holds how many phrases end


def transitions(codes: Iterable[int]) -> list[dict[int, int]]:
    """By state, the transitions of the automaton that accepts all substrings of codes."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(moves[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def suffix_automaton(codes: Iterable[int], classes: int) -> np.ndarray:
    """The automaton's table of transitions (-1: none)."""
    return dense(transitions(codes), classes)


def dense(moves: list[dict[int, int]], classes: int) -> np.ndarray:
    table = np.full((len(moves), classes), -1, np.int32)
    for s, own in enumerate(moves):
        table[s, list(own)] = list(own.values())
    return table


@functools.cache
def _letters() -> tuple[np.ndarray, list[tuple[int, str]]]:
    """The code points of letters, and those that lower case changes."""
    letters = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i))[0] == "L"]
    return np.array(letters), [(i, low) for i in letters if (low := chr(i).lower()) != chr(i)]


class CrossParser:
    """Learned from (language, text) samples. Languages are sorted, so ties go to the first in order."""

    def __init__(self, samples: dict[str, str], cells: int = DENSE_CELLS):
        self.languages = sorted(samples)
        seen: Counter = Counter()
        for text in samples.values():
            seen.update(c for c in text.lower() if c.isalpha())
        self.own = {c: k + 2 for k, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0])))}
        self.classes = len(self.own) + 2
        self.lut = self._lut()
        #: By language, the class in its table of each class; letters that its sample lacks are OTHER.
        self.local = np.full((len(self.languages), self.classes), OTHER, np.int32)
        self.local[:, SEPARATOR] = SEPARATOR
        self.dense, self.sparse = [], []  # numbers of languages; the latter with width, keys, next states, root
        tables, base = [], []
        n = 0
        for j, lang in enumerate(self.languages):
            codes, offsets = self.codes(samples[lang])
            codes = codes[self.single(codes, offsets)]
            letters = np.unique(codes[codes > OTHER])
            width = len(letters) + 2
            self.local[j, letters] = np.arange(2, width)
            moves = transitions(self.local[j, codes].tolist())
            if n + len(moves) * width <= cells:
                table = dense(moves, width).astype(np.int64)
                root = np.where(table[0] < 0, n, table[0] * width + n)  # states are places of rows
                ends = 1 + (table[0] < 0).astype(np.int64)  # a phrase before this character, and the character itself if it is unknown
                table = np.where(table < 0, root | ends << ENDED, table * width + n)
                table[0] = root | (ends - 1) << ENDED
                tables.append(table.astype(np.int32).ravel())
                base.append(n)
                self.dense.append(j)
                n += table.size
            else:
                keys = np.array([s * width + c for s, own in enumerate(moves) for c in own], np.int64)
                after = np.array([x for own in moves for x in own.values()], np.int32)
                order = np.argsort(keys)
                root = np.zeros(width, np.int32)
                root[list(moves[0])] = list(moves[0].values())
                self.sparse.append((j, width, keys[order], after[order], root))
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.base = np.array(base, np.int64)
        self.near = self.local[self.dense]
        #: Bits of a phrase: a place in the language's training text.
        self.bits = np.array([np.log2(max(2, len(samples[x]))) for x in self.languages])

    def _lut(self) -> np.ndarray:
        letters, cased = _letters()
        lut = np.full(sys.maxunicode + 1, SEPARATOR, np.min_scalar_type(self.classes))
        lut[letters] = OTHER
        for c, k in self.own.items():
            lut[ord(c)] = k
        for i, low in cased:
            lut[i] = self.own.get(low, self.own.get(low[0], OTHER))
        return lut

    def codes(self, *texts: str) -> tuple[np.ndarray, np.ndarray]:
        """Classes of all characters, and the texts' offsets."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        return self.lut[points], np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    @staticmethod
    def single(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """True but for separators after separators of the same text."""
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != SEPARATOR) | (codes[:-1] != SEPARATOR)
        keep[offsets[:-1][np.diff(offsets) > 0]] = True
        return keep

    def _step(self, state: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By language (dense ones first) and lane: the states after the classes now, and the phrases that end."""
        d = len(self.dense)
        after, ended = np.empty_like(state), np.empty_like(state)
        if d:
            step = self.table[state[:d] + self.near[:, now]]
            after[:d], ended[:d] = step & ((1 << ENDED) - 1), step >> ENDED
        for i, (j, width, keys, moves, root) in enumerate(self.sparse, d):
            c = self.local[j, now]
            if not len(keys):
                after[i], ended[i] = 0, 1
                continue
            key = state[i] * width + c
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            known = keys[at] == key
            after[i] = np.where(known, moves[at], root[c])
            ended[i] = np.where(known, 0, (state[i] > 0).astype(np.int64) + (root[c] == 0))
        return after, ended

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: phrases by language, characters that were parsed, letters, letters by language that it doesn't know."""
        codes, offsets = self.codes(*texts)
        keep = self.single(codes, offsets)
        place = _counts(keep, offsets)
        letters = _counts(codes != SEPARATOR, offsets)
        codes = codes[keep]
        size = np.diff(place)
        lanes = -(-size // SEGMENT)
        text = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = place[:-1][text] + nth * SEGMENT
        length = np.minimum(SEGMENT, place[1:][text] - start)
        k = len(self.languages)
        roots = np.concatenate([self.base, np.zeros(len(self.sparse), np.int64)])[:, None]
        last, count = np.repeat(roots, len(text), 1), np.zeros((k, len(text)), np.int64)
        order = np.argsort(-length, kind="stable")
        state, ended, first = last.copy(), count.copy(), start[order]
        active = np.searchsorted(-length[order], -np.arange(length.max() if len(length) else 0), "left")  # lanes longer than each step
        for t, n in enumerate(active.tolist()):
            state[:, :n], more = self._step(state[:, :n], codes[first[:n] + t])
            ended[:, :n] += more
        last[:, order], count[:, order] = state, ended
        todo = np.flatnonzero(nth)
        began = np.repeat(roots, len(text), 1)  # the states in which lanes have been counted
        while len(todo):
            # Lanes whose text goes on from another state than they were counted from.
            lane, a, b = todo, last[:, todo - 1], began[:, todo]
            began[:, todo] = a
            moved = []
            for t in range(SEGMENT):
                done = t >= length[lane]
                if done.any():
                    changed = done & (a != b).any(axis=0)
                    last[:, lane[changed]] = a[:, changed]
                    moved.append(lane[changed])
                go = ~done & (a != b).any(axis=0)
                lane, a, b = lane[go], a[:, go], b[:, go]
                if not len(lane):
                    break
                now = codes[start[lane] + t]
                a, more = self._step(a, now)
                b, less = self._step(b, now)
                count[:, lane] += more - less
            else:
                last[:, lane] = a
                moved.append(lane)
            moved = np.concatenate([todo[:0], *moved]) + 1
            todo = np.unique(moved[moved < len(text)])
            todo = todo[nth[todo] > 0]
        open_at_end = (last != roots) & (np.append(nth[1:], 0) == 0)
        phrases = np.zeros((k, len(texts)))
        for i, j in enumerate([*self.dense, *(x[0] for x in self.sparse)]):
            phrases[j] = np.bincount(text, count[i] + open_at_end[i], len(texts))
        strange = np.stack([np.diff(_counts(own[codes] == OTHER, place)) for own in self.local]) if k else phrases
        return phrases, size, np.diff(letters), strange

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages (und: no letters), scores and bits per character under the winner.

        The score is 1 - best / second of the languages' bits, so 0 is a tie; with one language it is 1.
        """
        phrases, size, letters, strange = self.parse(texts)
        none = (letters == 0) | (not self.languages)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        rate = (phrases * self.bits[:, None] + strange * LITERAL) / np.maximum(size, 1)
        best = rate.argmin(axis=0)
        ranked = np.sort(rate, axis=0)
        score = np.where(none, 0.0, 1 - ranked[0] / np.maximum(ranked[1], 1e-300) if len(ranked) > 1 else 1.0)
        return ["und" if x else self.languages[b] for x, b in zip(none, best, strict=True)], score, ranked[0]


def _counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags stand before each offset."""
    total = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=total[1:], dtype=np.int32)
    return total[offsets].astype(np.int64)


def held_out(id_col: str, rest: int = 0):
    """The fold of a document: crc32 of its id as text, modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == rest, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> CrossParser:
    """Learns all languages from a bounded sample of labelled documents that are not held out, in two scans.

    Per language, the sample is the documents with the smallest hashes of their ids, sample_docs at most,
    each with an equal share of sample_chars, from a place in its whole text that the id's hash gives.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    parts = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    counts = {r["lang"]: r["count"] for r in parts.groupBy("lang").count().collect()}
    chars = min(sample_chars, ALL_CHARS // max(1, len(counts)))
    # Sampling by a hash bound keeps about twice the documents that are taken.
    wanted = [(lang, int(min(1.0, 2.0 * sample_docs / n) * (1 << 20)) + 1, max(1, chars // min(sample_docs, n))) for lang, n in counts.items()]
    bounds = docs.sparkSession.createDataFrame(wanted, "lang string, bound long, share int")
    # A row per language; without the broadcast all texts would be dealt by language.
    near = parts.join(F.broadcast(bounds) if len(wanted) <= MOST_SENT else bounds, "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("bound"))
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - F.col("share"), F.lit(0)) + 1).cast("int") + 1
    near = near.select("lang", "h", F.substr("text", place, F.col("share")).alias("t"))
    picked = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))).where(F.col("n") <= sample_docs).collect()
    samples: dict[str, list] = {lang: [] for lang in counts}
    for r in sorted(picked, key=lambda r: r["n"]):
        samples[r["lang"]].append(r["t"])
    return CrossParser({lang: "\n".join(own) for lang, own in samples.items()})


def judged(docs: DataFrame, parser: CrossParser, text_col: str = "text") -> Column:
    """A text's struct of lang_pred, score (0 to 1) and bits (per character, under the winner).

    Null texts and texts without a letter are und with score 0. Each text is judged by itself, whole, so
    repeated rows get equal answers; ties go to the language first in order.
    """
    box = docs.sparkSession.sparkContext.broadcast(parser)  # bounded by ALL_CHARS

    @F.arrow_udf("struct<lang_pred string, score double, bits double>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        given_back()
        for column in columns:
            lang, scores, bits = [], [], []
            for part in slices_by_bytes(pa.record_batch([column], ["text"]), 0, SLICE):
                own, score, bit = box.value.predict([x or "" for x in part.column(0).to_pylist()])
                lang += own
                scores.append(score)
                bits.append(bit)
            none = np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate([none, *scores])), pa.array(np.concatenate([none, *bits]))], names=["lang_pred", "score", "bits"])
        given_back()

    return run.asNondeterministic()(F.col(text_col).cast("string"))  # so that the planner doesn't run it twice


def identify(docs: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score and bits, as judged says; other columns, whatever their names, are not read."""
    return docs.select(F.col(id_col).alias("id"), judged(docs, parser, text_col).alias("j")).select(F.col("id").alias(id_col), "j.lang_pred", "j.score", "j.bits")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on the documents that are not held out and predicts all: id, held_out, lang_pred, score."""
    out = identify(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
