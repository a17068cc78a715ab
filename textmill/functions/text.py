"""Text functions as Catalyst expressions: tokens, sentences, soundex, k-grams, n-grams, highlighting."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 25 stop words of the retrieval engine.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with")


def tokens(text: Column | str) -> Column:
    """Profile simple: runs of letters, lower-cased. Null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def treebank_tokens(text: Column | str) -> Column:
    """Profile treebank: splits punctuation and English contractions off, keeps hyphens; lower-cased."""
    out = F.lower(text)
    for pattern, by in (
        (r"^\"|(?<=[ (\[{<])\"", " `` "),
        (r"\"", " '' "),
        (r"\.\.\.", " ... "),
        (r"([,;:@#$%&?!\[\](){}<>])", " $1 "),
        (r"--", " -- "),
        (r"(?<!\.)\.(?=[\])}>\"']*\s*($|\s+\S))(?=\s*$|\s+)", " . "),
        (r"([^'])' ", "$1 ' "),
        (r"('s|'m|'d|'ll|'re|'ve|n't)(?= |$)", " $1"),
        (r"\b(can)(not)\b", "$1 $2"),
        (r"\b(gim|lem)(me)\b", "$1 $2"),
        (r"\b(gon|wan)(na)\b", "$1 $2"),
        (r"\b(got)(ta)\b", "$1 $2"),
    ):
        out = F.regexp_replace(out, pattern, by)
    return F.filter(F.split(out, r"\s+"), lambda x: x != "")


def is_kept(token: Column | str, stop: Iterable[str] = STOP_WORDS) -> Column:
    """Letters only and no stop word."""
    token = F.col(token) if isinstance(token, str) else token
    return token.rlike(r"^\p{L}+$") & ~token.isin(*stop)


def without_stop_words(words: Column, stop: Iterable[str] = STOP_WORDS) -> Column:
    """The words that are no stop words, joined by blanks."""
    return F.array_join(F.filter(words, lambda x: ~x.isin(*stop)), " ")


def sentences(text: Column | str) -> Column:
    """Cut after a full stop, exclamation or question mark that white space follows; raw sentences, empty ones left out."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def cleaned(sentence: Column, stop: Iterable[str] = STOP_WORDS) -> Column:
    """Other than a-z to blanks, lower-cased, without stop words."""
    words = F.filter(F.split(F.lower(F.regexp_replace(sentence, "[^a-zA-Z]", " ")), " +"), lambda w: w != "")
    return without_stop_words(words, stop)


# Soundex classes; letters of class 0 only separate.
_SOUNDEX = {"0": "aeiouyhw", "1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}


def soundex(word: Column | str) -> Column:
    """First letter as it is and three digits; h and w separate like vowels; null for other than a-z."""
    word = F.col(word) if isinstance(word, str) else word
    letters = "".join(_SOUNDEX.values())
    digits = "".join(d * len(own) for d, own in _SOUNDEX.items())
    code = F.translate(F.substring(word, 2, 1 << 20), letters, digits)
    code = F.replace(F.regexp_replace(code, r"([0-9])\1+", "$1"), F.lit("0"), F.lit(""))
    return F.when(word.rlike("^[a-z]+$"), F.concat(F.substring(word, 1, 1), F.substring(F.rpad(code, 3, "0"), 1, 3)))


def kgrams(word: Column, k: int, short: bool = False) -> Column:
    """k-grams of the word between dollar signs, repeats kept.

    With short, also the shorter pieces at the end that start before n - n % k, n with the dollar signs.
    """
    padded = F.concat(F.lit("$"), word, F.lit("$"))
    n = F.length(padded)
    last = (n - n % k) if short else n - k + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(padded, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def pattern_grams(pattern: Column, k: int) -> Column:
    """The grams of a wildcard pattern that words can be looked up by: neither $ alone nor with a star."""
    return F.array_distinct(F.filter(kgrams(pattern, k), lambda g: (g != "$") & ~F.contains(g, F.lit("*"))))


def as_regex(pattern: Column) -> Column:
    """A wildcard pattern as a whole-string regular expression."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("$"))


def ngrams(words: Column, n: int) -> Column:
    """Sliding n-grams, joined by blanks."""
    some = F.size(words) - n + 1
    out = F.slice(words, 1, some)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(words, k, some), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) >= n, out).otherwise(F.array().cast("array<string>"))


def highlight(text: Column | str, terms: Column, start: str = "<em>", end: str = "</em>") -> Column:
    """Each occurrence of a term as a whole word, whatever its case, between the markers, once."""
    quoted = F.transform(terms, lambda t: F.regexp_replace(t, r"([\\.\[\]{}()*+?^$|])", r"\\$1"))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}])("), F.array_join(quoted, "|"), F.lit(r")(?![\p{L}])"))
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.size(terms) > 0, F.regexp_replace(text, pattern, F.lit(f"{start}$1{end}"))).otherwise(text)


def rouge1(a: Column, b: Column) -> Column:
    """Share of a's distinct words that b has; 0 if a has none."""
    own = F.array_distinct(a)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(own)), F.lit(0.0))


def resolved_url(base: Column, href: Column) -> Column:
    """An href against the page's URL: absolute, //host, /root, #fragment, ?query or relative to the folder."""
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    site = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(base, "#.*$", "")
    path = F.regexp_replace(bare, r"\?.*$", "")
    folder = F.when(F.length(path) > F.length(site), F.regexp_replace(path, "[^/]*$", "")).otherwise(F.concat(site, F.lit("/")))
    relative = _without_dots(F.concat(folder, href), site)
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(bare, href))
        .when(href.startswith("?"), F.concat(path, href))
        .otherwise(relative)
    )


def _without_dots(url: Column, site: Column) -> Column:
    """Resolves . and .. steps of the path, in one pass over its parts."""
    tail = F.regexp_extract(url, "([?#].*)?$", 1)
    path = F.substring(url, F.length(site) + 2, F.length(url) - F.length(site) - F.length(tail) - 1)
    empty = F.array().cast("array<string>")
    kept = F.aggregate(F.split(path, "/"), empty, lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    closing = F.when(path.rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(site, F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, closing).otherwise(F.lit("")), tail)).otherwise(url)


def links(html: Column) -> Column:
    """The href of each a tag, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))


def wildcard_matches(pattern: str, word: str) -> bool:
    """Python twin of as_regex, for tests and small checks."""
    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), word) is not None
