"""Porter's stemming algorithm (1980) with the usual extensions, for the distinct vocabulary only."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Irregular forms of the extended algorithm.
_IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}

# Suffixes and what replaces them, tried in this order, in steps 2 and 3.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _consonant(word: str, i: int) -> bool:
    if word[i] in "aeiou":
        return False
    if word[i] == "y":
        return i == 0 or not _consonant(word, i - 1)
    return True


def _measure(stem: str) -> int:
    kinds = [_consonant(stem, i) for i in range(len(stem))]
    return sum(b and not a for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(word: str) -> bool:
    return len(word) >= 2 and word[-1] == word[-2] and _consonant(word, len(word) - 1)


def _cvc(word: str) -> bool:
    if len(word) >= 3:
        return _consonant(word, len(word) - 3) and not _consonant(word, len(word) - 2) and _consonant(word, len(word) - 1) and word[-1] not in "wxy"
    return len(word) == 2 and not _consonant(word, 0) and _consonant(word, 1)


@lru_cache(100_000)
def stem(word: str) -> str:
    word = word.lower()
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if len(word) <= 2:
        return word
    # 1a: plurals
    if word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    else:
        for end, by in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
            if word.endswith(end):
                word = word[: -len(end)] + by
                break
    # 1b: -eed, -ed, -ing
    if word.endswith("ied"):
        word = word[:-3] + ("ie" if len(word) == 4 else "i")
    elif word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and _has_vowel(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    # 1c: y after a consonant
    if word.endswith("y") and len(word) > 2 and _consonant(word, len(word) - 2):
        word = word[:-1] + "i"
    # 2
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        word = word[:-2]
    for end, by in (*_STEP2, ("logi", "log")):
        if word.endswith(end):
            if _measure(word[: -3 if end == "logi" else -len(end)]) > 0:
                word = word[: -len(end)] + by
            break
    # 3
    for end, by in _STEP3:
        if word.endswith(end):
            if _measure(word[: -len(end)]) > 0:
                word = word[: -len(end)] + by
            break
    # 4: the longest suffix that fits
    for end in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(end):
            rest = word[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    # 5a: final e; 5b: -ll
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or _measure(rest) == 1 and not _cvc(rest):
            word = rest
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stemmed_words(words: Column) -> Column:
    """The stems of an array of words; a batch's distinct words go through Python once."""

    @F.arrow_udf("array<string>")
    def stems(column: pa.Array) -> pa.Array:
        own = column.values.cast(pa.string()).dictionary_encode()
        known = pa.array([None if w is None else stem(w) for w in own.dictionary.to_pylist()], pa.string())
        return pa.ListArray.from_arrays(column.offsets, known.take(own.indices), mask=column.is_null())

    return stems(words)
