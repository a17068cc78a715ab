"""Personal data: base patterns, and a skip-chain conditional random field over number and address tokens.

Nodes are the tokens with a digit or an at sign, and spelled addresses ("jo at mail dot org"). Neighbouring
nodes share chain potentials; tokens of one document that repeat, or end in the same digits, share skip
potentials (each with its next such token, so edges stay linear in the nodes). Loopy belief propagation runs
until the messages stand still and gives every node's label posterior, so labels agree over a document: a
number that is a phone in one place is one where its prefix is missing.

Training is piecewise: node potentials by softmax regression, edge potentials by smoothed pointwise mutual
information of neighbouring labels, on a bounded sample whose labels are the base patterns' matches and, as
a fifth kind, long tokens of letters and digits that something is set to ("token = ..."). Base patterns are
precise but strict, so each sampled text with matches is also learned from with these rewritten as people
write them (no prefix, other separators, spelled addresses) under the same label, and with dates, prices,
versions and the like put in, whose label is other.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm._common import given_back, slices_by_bytes, thinned

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")  # the base patterns have no secrets
LABELS = ("other", *ALL_KINDS)
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 4000  # of each sampled document, from a place that its id's hash gives
SURE = 0.85  # posterior that a node of an added span must reach
SWEEPS = 60  # at most; messages mostly stand still after about ten
STILL = 1e-3

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN_END = re.compile(r"\S*")
_AT = re.compile(r" ?(?:\[at\]|\(at\)|(?<= )at(?= )) ?")
_AFTER_AT = re.compile(r"[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|(?<= )dot(?= )|\.(?=[A-Za-z0-9])) ?[A-Za-z0-9-]{1,63}){1,8}")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2,20}[\"']? ?[:=]{1,2} ?[\"']?(?=[0-9]*+[A-Za-z])(?=[A-Za-z]*+[0-9])([A-Za-z0-9_/+-]{20,200})(?![A-Za-z0-9_/+-])")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


class Span(NamedTuple):
    start: int
    end: int
    kind: int  # index into KINDS


def base_spans(text: str) -> list[Span]:
    """The base patterns' matches, leftmost and non-overlapping per kind, by start, then kind.

    The patterns are anchored where a match has to begin or at its at sign, so long runs take linear time.
    """
    out = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(Span(start, m.end(), 0))
                done = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x := g.lstrip("0")) <= 3 and int(x or "0") <= 255 for g in m.groups()):
                out.append(Span(m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(Span(m.start(), m.end(), 2))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(Span(m.start(), m.end(), 3))
        out.sort(key=lambda s: (s.start, s.kind))
    return out


def spelled(text: str) -> list[tuple[int, int]]:
    """Places that read like a spelled address: a word, at, and words with dots, of which one is spelled."""
    out = []
    for m in _AT.finditer(text):
        start = m.start()
        low = max(out[-1][1] if out else 0, start - 64)
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        after = _AFTER_AT.match(text, m.end())
        if start < m.start() and after and ("[" in m[0] or "(" in m[0] or "dot" in after[0]):
            out.append((start, after.end()))
    return out


def secrets(text: str) -> list[tuple[int, int]]:
    """Long tokens of both letters and digits that something is set to."""
    return [m.span(1) for m in _SECRET.finditer(text)] if "=" in text or ":" in text else []


def nodes(text: str) -> list[tuple[int, int]]:
    """Tokens (runs other than white space) with a digit or an at sign, and spelled addresses."""
    out, done = [], 0
    whole = spelled(text) if "at" in text else []
    k = 0
    m = _MARK.search(text)
    while m or k < len(whole):
        at = m.start() if m else len(text)
        if k < len(whole) and whole[k][0] <= at:
            if whole[k][0] >= done:
                out.append(whole[k])
                done = whole[k][1]
            k += 1
            m = _MARK.search(text, done)
            continue
        start = at
        while start > done and not text[start - 1].isspace():
            start -= 1
        done = _TOKEN_END.match(text, at).end()
        out.append((start, done))
        m = _MARK.search(text, done)
    return out


N_FEATURES = 48
_EDGES = ".,;:!?\"'<>[]#$%&*|~"
_SPLIT_PHONE = re.compile(r"(?:1[-. ]?)?\(?[0-9]{3}\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4}")
_DATE = re.compile(r"(?:1[89]|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:1[89]|20)?[0-9]{2}|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?")


def features(token: str, before: str, after: str, run: str, lead: str) -> list[int]:
    """Active features of a token; before and after are the neighbouring nodes next to it, or empty.

    run: the neighbouring nodes of digits, dots, hyphens and brackets that it stands among; lead: what stands before it.
    """
    core = token.strip(_EDGES)
    digits = sum(c.isdigit() for c in core)
    letters = sum(c.isalpha() for c in core)
    at, dots = core.count("@"), core.count(".")
    out = [0]
    for k, bound in enumerate((1, 4, 7, 10, 14, 20), 1):
        if digits >= bound:
            out.append(k)
    own = "".join(c for c in run if "0" <= c <= "9")
    tests = (
        at == 1,
        at == 1 and "." in core.partition("@")[2],
        dots == 3,
        dots == 3 and not letters and digits + 3 == len(core),
        digits == len(core),
        letters == 0,
        letters > digits,
        core[:1] == "+",
        "(" in core or ")" in core,
        "-" in core,
        "=" in core or "/" in core or "_" in core,
        14 <= digits <= 19 and letters == 0 and luhn("".join(c for c in core if "0" <= c <= "9")),
        any(ord(c) > 127 for c in core),
        before[:1] == "+",
        ")" in before,
        ")" in after,
        bool(before),
        bool(after),
        "$" in token or "%" in token or "€" in token or "£" in token,
        at == 0 and letters > 0 and digits == 0,  # a spelled address
        at == 0 and letters > 0 and ("[" in core or "(" in core) and ("[dot" in core or "(dot" in core),
        at == 0 and letters > 0 and " dot " in core,
        7 <= len(own) <= 9,
        10 <= len(own) <= 11,
        12 <= len(own) <= 13,
        14 <= len(own) <= 19 and luhn(own),
        14 <= len(own) <= 19 and not luhn(own),
        bool(_SPLIT_PHONE.fullmatch(run)),
        len(own) in (13, 14, 15, 16) and run.count(" ") + run.count(".") + run.count("-") == 3 and luhn(own),
        bool(_DATE.fullmatch(core)),
        letters >= 4 and digits >= 4 and letters + digits >= 20,
        letters >= 4 and digits >= 4 and letters + digits >= 20 and lead in ("=", ":"),
        lead in ("=", ":"),
        dots == 3 and not letters and all(len(x) <= 3 and int(x) <= 255 for x in core.split(".") if x.isascii() and x.isdigit()) and len(core.split(".")) == 4,
        dots == 1 and not letters,
        dots == 2,
        "," in core and not letters,
    )
    out += [7 + k for k, x in enumerate(tests) if x]
    return out


def skip_keys(token: str) -> list[str]:
    """What makes two tokens of a document repeated or similar."""
    core = token.strip(_EDGES + "()").lower()
    digits = "".join(c for c in core if "0" <= c <= "9")
    out = [f"t{core}"] if "@" in core or len(digits) >= 4 else []
    return out + [f"d{digits[-7:]}"] * (len(digits) >= 7)


_RUN = re.compile(r"[0-9().+-]+")
_LONGEST_RUN = 8  # nodes that are looked at as one number


class Graph:
    """Nodes of any number of documents with their features and edges; documents aren't linked."""

    def __init__(self):
        self.spans: list[tuple[int, int, int]] = []  # document, start, end
        self.node: list[int] = []  # node of each active feature
        self.feature: list[int] = []
        self.chain: list[int] = []  # nodes that share a chain potential with the next node
        self.skip: list[tuple[int, int]] = []

    def add(self, number: int, text: str) -> None:
        own = nodes(text)
        last: dict[str, int] = {}
        near = [b[0] - a[1] <= 1 for a, b in zip(own, own[1:], strict=False)]
        tokens = [text[a:b] for a, b in own]
        digits = [bool(_RUN.fullmatch(t.strip(_EDGES))) for t in tokens]
        for k, (a, b) in enumerate(own):
            i = len(self.spans)
            before = tokens[k - 1] if k and near[k - 1] else ""
            after = tokens[k + 1] if k < len(near) and near[k] else ""
            token = tokens[k]
            low = high = k
            if digits[k]:
                while low and k - low < _LONGEST_RUN and near[low - 1] and digits[low - 1] and tokens[low - 1][-1:] not in ",;":
                    low -= 1
                while high < len(near) and high - k < _LONGEST_RUN and near[high] and digits[high + 1] and tokens[high][-1:] not in ",;":
                    high += 1
            lead = text[max(0, a - 3) : a].rstrip(" \"'")[-1:]
            active = features(token, before, after, text[own[low][0] : own[high][1]].strip(_EDGES), lead)
            self.node += [i] * len(active)
            self.feature += active
            if after:
                self.chain.append(i)
            for other in {last[key] for key in skip_keys(token) if key in last} - ({i - 1} if before else set()):
                self.skip.append((other, i))
            last.update((key, i) for key in skip_keys(token))
            self.spans.append((number, a, b))

    def matrix(self) -> np.ndarray:
        x = np.zeros((len(self.spans), N_FEATURES), np.float32)
        x[self.node, self.feature] = 1
        return x

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([(i, i + 1) for i in self.chain], np.int64).reshape(-1, 2), np.array(self.skip, np.int64).reshape(-1, 2)

    def labels(self, spans: list[list[Span]]) -> np.ndarray:
        """Each node's label by the given spans of the documents: the first kind that overlaps it."""
        covers = [Cover(own) for own in spans]
        return np.array([covers[number].kind(a, b) for number, a, b in self.spans], np.int64) + 1


class Cover:
    """Spans by place: finding one that overlaps a range takes logarithmic time."""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends, self.kinds = [], [], []
        for s in sorted(spans):
            if self.ends and s.start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], s.end)
            else:
                self.starts.append(s.start)
                self.ends.append(s.end)
                self.kinds.append(s.kind)

    def kind(self, a: int, b: int) -> int:
        """The kind of the first span that overlaps a to b; -1 if none does."""
        i = bisect.bisect_right(self.ends, a)
        return self.kinds[i] if i < len(self.starts) and self.starts[i] < b else -1


def known_spans(text: str) -> list[Span]:
    """What is learned from: base matches, and secrets that no base match overlaps."""
    base = base_spans(text)
    cover = Cover(base)
    return base + [Span(a, b, 4) for a, b in secrets(text) if cover.kind(a, b) < 0]


def rewritten(text: str, spans: list[Span], rng: random.Random) -> tuple[str, list[Span]]:
    """The text with its matches as people write them, and with numbers that are no personal data put in."""
    out, own, n, done = [], [], 0, 0

    def put(x: str) -> None:
        nonlocal n
        out.append(x)
        n += len(x)

    for s in sorted(spans):
        if s.start < done:
            continue
        put(text[done : s.start])
        x = text[s.start : s.end]
        digits = "".join(c for c in x if "0" <= c <= "9")
        if s.kind == 0:
            at, dot = rng.choice(((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", ".")))
            name, _, site = x.partition("@")
            x = name.lstrip(".%+-") + at + site.replace(".", dot) if name.strip(".%+-") else x
        elif s.kind == 2 and len(digits) == 16:
            x = rng.choice((".", " - ", " ", "")).join(digits[k : k + 4] for k in range(0, 16, 4))
        elif s.kind == 3 and len(digits) >= 10:
            k = digits[-10:]
            x = rng.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "1-{}-{}-{}", "{}{}{}")).format(k[:3], k[3:6], k[6:])
        if s.kind == 1:
            x = x.replace(".", rng.choice((".", "[.]", "-")), 3) if rng.random() < 0.3 else x
        own.append(Span(n, n + len(x), s.kind))
        put(x)
        done = s.end
        if rng.random() < 0.5:
            r = rng.randint
            put(" ")
            put(rng.choice((f"{r(1900, 2030)}-{r(1, 12):02d}-{r(1, 28):02d}", f"{r(1, 28)}/{r(1, 12)}/{r(1990, 2030)}", f"{r(0, 23)}:{r(0, 59):02d}", f"${r(1, 9999)}.{r(0, 99):02d}", f"{r(0, 9)}.{r(0, 20)}.{r(0, 20)}", f"{r(1, 999)},{r(0, 999):03d},{r(0, 999):03d}", f"{r(1, 10 ** 6)}", f"{r(1900, 2030)}-{r(1900, 2030)}", f"{r(10 ** 15, 10 ** 16 - 1)}", f"{r(10 ** 7, 10 ** 9)}", f"{r(1, 99)}%", f"{r(0, 99)} {r(0, 99)} {r(0, 99)}")))
            put(" ")
    put(text[done:])
    return "".join(out), own


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top


class SkipChainCRF:
    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    @classmethod
    def fit(cls, texts: list[str], steps: int = 300) -> SkipChainCRF:
        graph, k, rng = Graph(), len(LABELS), random.Random(7)
        spans = [known_spans(t) for t in texts]
        given = list(zip(texts, spans, strict=True))
        given += [rewritten(t, own, rng) for t, own in given if own]
        for i, (t, _) in enumerate(given):
            graph.add(i, t)
        y = graph.labels([own for _, own in given])
        weights = np.zeros((N_FEATURES, k))
        weights[0, 0] = 4.0  # without samples nothing is found
        pairwise = []
        if len(y):
            x = graph.matrix().astype(np.float64)
            truth = np.eye(k)[y]
            for step in range(steps):
                score = x @ weights
                p = np.exp(score - _log_sum(score, 1))
                weights += 2.0 / (1 + step / 100) * (x.T @ (truth - p) / len(y) - 1e-5 * weights)
        prior = (np.bincount(y, minlength=k) + 1.0) / (len(y) + k)
        for edges, agree in zip(graph.edges(), (0.0, 40.0), strict=True):
            joint = np.outer(prior, prior) * 20 + agree * np.diag(prior)  # prior counts: neighbours are independent, repeated tokens mostly agree
            np.add.at(joint, (y[edges[:, 0]], y[edges[:, 1]]), 1.0)
            joint = (joint + joint.T) / (2 * joint.sum())
            own = joint.sum(axis=0)
            pairwise.append(np.clip(np.log(joint / np.outer(own, own)), -4, 4))
        return cls(weights, *pairwise)

    def posteriors(self, graph: Graph, sweeps: int = SWEEPS) -> np.ndarray:
        """Label posteriors of all nodes by loopy belief propagation; messages of all edges pass at once.

        Sweeps end when no message moves by more than STILL, or after so many; on trees the result is exact.
        """
        score = graph.matrix() @ self.unary
        return self.propagated(score, *graph.edges(), sweeps)

    def propagated(self, score: np.ndarray, chain: np.ndarray, skip: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
        if not len(score):
            return score
        a = np.concatenate([chain[:, 0], skip[:, 0], chain[:, 1], skip[:, 1]])
        b = np.concatenate([chain[:, 1], skip[:, 1], chain[:, 0], skip[:, 0]])
        n = len(chain) + len(skip)
        if n:
            c = len(chain)
            forward = [(slice(0, c), np.exp(self.chain)), (slice(c, n), np.exp(self.skip))]
            groups = forward + [(slice(own.start + n, own.stop + n), p.T) for own, p in forward]
            message = np.zeros((2 * n, score.shape[1]))
            damping = 0.0
            for sweep in range(sweeps):
                belief = score.copy()
                np.add.at(belief, b, message)
                new = belief[a]
                new[:n] -= message[n:]  # without what came over the same edge
                new[n:] -= message[:n]
                new = np.exp(new - new.max(axis=1, keepdims=True))
                for own, p in groups:
                    new[own] = np.log(new[own] @ p)
                new -= _log_sum(new, 1)
                moved = np.abs(new - message).max()
                message = damping * message + (1 - damping) * new
                if moved <= STILL:
                    break
                if sweep >= 8:
                    damping = 0.5  # loops may swing
            score = score.copy()
            np.add.at(score, b, message)
        return np.exp(score - _log_sum(score, 1))


def found(texts: list[str], crf: SkipChainCRF) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text."""
    base = [base_spans(t) for t in texts]
    graph = Graph()
    for i, t in enumerate(texts):
        graph.add(i, t)
    post = crf.posteriors(graph)
    added: list[list[Span]] = [[] for _ in texts]
    if len(post):
        covers = [Cover(own) for own in base]
        label, sure = post.argmax(axis=1).tolist(), (post.max(axis=1) >= SURE).tolist()
        chained = set(graph.chain)
        i = 0
        while i < len(post):
            k = label[i]
            j = i
            while k in (3, 4) and j in chained and label[j + 1] == k and not _whole(texts, graph.spans[j + 1], k):
                j += 1
            if k and any(sure[i : j + 1]):
                number, a, _ = graph.spans[i]
                b = graph.spans[j][2]
                if covers[number].kind(a, b) < 0 and (span := trimmed(texts[number], a, b, k - 1)):
                    added[number].append(span)
            i = j + 1
    return list(zip(base, added, strict=True))


def _whole(texts: list[str], node: tuple[int, int, int], label: int) -> bool:
    """Whether a node is a card's or phone's whole number by itself, so not the rest of the one before."""
    digits = sum("0" <= c <= "9" for c in texts[node[0]][node[1] : node[2]])
    return digits >= (13, 10)[label - 3]


def trimmed(text: str, a: int, b: int, kind: int) -> Span | None:
    """A span without the punctuation around it, if it can be of its kind at all."""
    if kind == 4:
        parts = [m for m in re.finditer(r"[A-Za-z0-9_/+-]{20,}", text[a:b]) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        return Span(a + parts[0].start(), a + parts[0].end(), 4) if parts else None
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while a < b and not text[b - 1].isalnum():
        b -= 1
    own = text[a:b]
    digits = sum("0" <= c <= "9" for c in own)
    fine = ("@" in own[1:-1] or "at" in own, own.count(".") == 3 and digits >= 4, 13 <= digits <= 19, 7 <= digits <= 15)[kind]
    return Span(a, b, kind) if fine and (kind == 0 or not any(c.isalpha() for c in own)) else None


def written(spans: list[Span]) -> str:
    return ",".join(f"{ALL_KINDS[s.kind]}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (s.start, s.kind, s.end)))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones together, replaced by its kind in brackets."""
    out, done = [], 0
    for s in sorted(spans):
        if s.start >= done:
            out += [text[done : s.start], f"[{ALL_KINDS[s.kind].upper()}]"]
        done = max(done, s.end)
    return "".join(out) + text[done:]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> SkipChainCRF:
    """Trains on a bounded sample: documents with a digit or an at sign, those with the smallest hashes of ids.

    Of a longer text it takes sample_chars from a place that the id's hash gives.
    """
    h = F.xxhash64(F.col(id_col).cast("string"))
    text = F.col(text_col).cast("string")
    place = F.pmod(F.xxhash64(h), F.greatest(F.length(text) - sample_chars, F.lit(0)) + 1).cast("int") + 1
    rows = docs.where(text.rlike("[0-9@]")).select(h.alias("h"), F.substr(text, place, F.lit(sample_chars)).alias("t"))
    return SkipChainCRF.fit([r["t"] for r in thinned(rows, "h", sample_docs).orderBy("h", "t").limit(sample_docs).collect()])


def spans_of(docs: DataFrame, crf: SkipChainCRF, text_col: str = "text", mask: bool = False) -> Column:
    """A text's struct of counts of base spans, base_sha256, spans (base and added) and n_added; with mask only the masked text.

    Null and empty texts have no spans; a null text stays null. Each text is judged by itself, whole.
    """
    box = docs.sparkSession.sparkContext.broadcast(crf)  # a few hundred weights
    kinds = ", ".join(f"n_{k} long" for k in KINDS)

    @F.arrow_udf("string" if mask else f"struct<{kinds}, base_sha256 string, spans string, n_added long>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        given_back()
        for column in columns:
            texts, rows = [], []
            for part in slices_by_bytes(pa.record_batch([column], ["text"]), 0, 1 << 20):
                own = part.column(0).to_pylist()
                for t, (base, added) in zip(own, found([t or "" for t in own], box.value), strict=True):
                    if mask:
                        texts.append(t and masked(t, base + added))
                    else:
                        rows.append((*(sum(s.kind == k for s in base) for k in range(len(KINDS))), hashlib.sha256(written(base).encode()).hexdigest(), written(base + added), len(added)))
            if mask:
                yield pa.array(texts, pa.string())
            else:
                columns_of = zip(*rows, strict=True) if rows else [[]] * (len(KINDS) + 3)
                types = (*[pa.int64()] * len(KINDS), pa.string(), pa.string(), pa.int64())
                yield pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns_of, types, strict=True)], names=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])
        given_back()

    return run.asNondeterministic()(F.col(text_col).cast("string"))  # so that the planner doesn't run it twice


def find(docs: DataFrame, crf: SkipChainCRF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added and found (any span); as spans_of says.

    Repeated rows get equal answers, ties between labels go to the first in order; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), spans_of(docs, crf, text_col).alias("s"))
    return rows.select(F.col("id").alias(id_col), "s.*", (F.col("s.spans") != "").alias("found"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fits on a sample of the documents and finds personal data in all of them."""
    return find(docs, fit(docs, id_col, text_col), id_col, text_col)
