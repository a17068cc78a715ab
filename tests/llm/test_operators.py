"""Each operator against brute force on small fixtures, with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("textmill.llm")

from textmill.llm import dual_tree, interpolation, jaccard_join, language_id, license_scan, packing, phrase_index, pii, token_counts, warc  # noqa: E402
from textmill.llm._common import Words  # noqa: E402
from textmill.shared import stored  # noqa: E402

P = pytest.importorskip("public_tokenizers")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    vocab = ["the", "of", "Été", "naïve", "w1", "w2", "Zürich", "x.y", "end.", "a-b", "数据", "😀", "\t", "\n", "  "]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice((1, 5, 40, 300))))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n\t "), (63, "x" * 5000), (None, "null id text here"), (0, rows[0][1]), (64, rows[1][1]), (65, "a\x00b <|endoftext|> <s> c")]
    return spark.createDataFrame([(i, t, "l", 7, True) for i, t in rows], "doc_id long, text string, n_tokens string, score int, held_out boolean").repartition(3)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def thue_morse(n, a="a", b="b"):
    """Two different words of n letters that every polynomial hash modulo 2**64 takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return tuple("".join((a, b)[x ^ y] for x in bits) for y in (0, 1))


def test_words(monkeypatch):
    rng = random.Random(1)
    for chunk in (4, 7, 1 << 20):
        monkeypatch.setattr("textmill.llm._common.CHUNK", chunk)
        for kind, cut in (("space", space_words), ("alnum", alnum_words)):
            for _ in range(200):
                texts = [None if rng.random() < 0.1 else "".join(rng.choice(["a", "B", "é", " ", "\n", "-", "9", "数"]) for _ in range(rng.choice((0, 1, 3, 30)))) for _ in range(rng.randint(0, 5))]
                words = Words(pa.array(texts, pa.string()), kind)
                assert [words.distinct[int(i)].as_py().decode() for i in words.number] == [w for t in texts for w in cut(t)]
                assert np.diff(words.rows).tolist() == [len(cut(t)) for t in texts]
    digest = Words(pa.array([" ".join(thue_morse(2048) + ("x" * 16, "x" * 17, "x" * 15))]), "space").digests()
    assert len({tuple(x) for x in digest.tolist()}) == len(set(digest[:, 0].tolist())) == 5


def test_long_text_memory():
    """One text of 64 MB takes under a gigabyte, whatever the operator."""
    import subprocess
    import sys

    code = """
import resource, sys
import pyarrow as pa
from textmill.llm import interpolation, jaccard_join, phrase_index
column = pa.array([("lorem ipsum dolor " * 40 + str(i) + " ") for i in range(90_000)])
column = pa.array(["".join(column.to_pylist())])
assert len(column[0].as_py()) > 64_000_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
if sys.argv[1] == "4":
    n = sum(int(number.size) - ghosts for _, _, _, number, ghosts, _ in interpolation._pieces(column))
elif sys.argv[1] == "5":
    n = len(phrase_index.ranked(phrase_index.Words(column, "alnum"))[1])
else:
    n = sum(len(x) for x in jaccard_join.shingle_sets(column))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    for op, least in (("4", 10_000_000), ("5", 10_000_000), ("8", 90_000)):
        n, mb = map(int, subprocess.run([sys.executable, "-c", code, op], capture_output=True, text=True, check=True).stdout.split())
        assert n >= least and mb < 1000, (op, n, mb)


def test_words_that_hash_alike(spark):
    """Thue-Morse words are other words: for counts, windows, links and ids."""
    from tokenizers import Tokenizer

    for n in (1024, 4096):
        a, b = thue_morse(n)
        df = spark.createDataFrame([(1, a), (2, b), (3, f"x {a} y"), (4, f"x {b} y"), (5, f"{b} {a}")], "doc_id long, text string")
        items = spark.createDataFrame([(7, b)], "item_id long, text string")
        assert {r["doc_id"]: r["n_hit"] for r in phrase_index.decontaminate(df, items).collect()} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 1}
        assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(df).collect()} == {i: i for i in range(1, 6)}
        assert {r["doc_id"]: r["n_known"] for r in interpolation.score(df, F.col("doc_id").isin(1, 3)).collect()} == {1: 2, 2: 1, 3: 4, 4: 3, 5: 2}
    whole, (a, b) = Tokenizer.from_file(P.path("byte_bpe_50k.json")), thue_morse(2048)
    texts = [f"x {a} {b} {a}", b, a]
    assert [ids.tolist() for ids, _ in packing._tokenizer(None).encode(pa.array(texts), 0)] == [e.ids + [0] for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = sorted((tuple(r) for r in token_counts.count_tokens(docs, limit=100).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for i, t in pairs(docs)]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(docs.limit(0)).isEmpty()


def test_resynchronisation(monkeypatch):
    rng = random.Random(1)
    counter = token_counts.ResyncCounter(P.path("piece_bpe_32k.model"), chunk=40, overlap=4)
    texts = ["".join(rng.choice(["a", "b", " ", "  ", "\n", "é", "▁", "😀", "0", "tion", "<s>"]) for _ in range(rng.randint(0, 400))) for _ in range(300)]
    texts += ["a" * 3000, " " * 3000, "é😀" * 500, "▁" * 900]
    want = [len(x) for x in counter.encoder.encode(texts)]
    for run in (1, 3, 4096):
        monkeypatch.setattr(token_counts, "RUN", run)
        assert counter.counts(texts) == want
    assert counter.widened


def test_top_products(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(150)]
    rows += [(150, None), (151, [1.0, None] + [0.0] * 4), (152, [math.nan] * 6), (None, [1.0] * 6), (160, [5.0, 1.0]), (180, [5.0, 1.0]), (153, [math.inf] * 6)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = {tuple(r) for r in dual_tree.top_products(df, F.col("vec_id") % 20 == 0, 5, block=32, query_block=3, leaves=8).collect()}
    ok = [(i, np.floor(64 * np.pad(np.float32(v).astype(float), (0, 6 - len(v))))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for i, v in ok:
        if i % 20 == 0:
            best = sorted((-int(v @ w), j) for j, w in ok if j != i)[:5]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    assert got == want
    assert dual_tree.top_products(df.limit(0), F.col("vec_id") % 20 == 0).isEmpty()
    few = spark.createDataFrame([(20, [1.0]), (1, [1.0]), (20, [2.0])], "vec_id long, embedding array<float>")
    # Rows that repeat an id are queries each, and each other's candidates.
    assert sorted(tuple(r) for r in dual_tree.top_products(few, F.col("vec_id") == 20, 5).collect()) == sorted([(20, 1, 20, 8192), (20, 2, 1, 4096), (20, 1, 1, 8192), (20, 2, 20, 8192)])


def test_large_components(spark):
    """Finite vectors of any size take part, in whole numbers; scores beyond 64 bits are the least or largest long."""
    rows = [(20, [1e8, 1.0]), (40, [3.0, 4.0]), (1, [1e8, 0.5]), (2, [-1e8, 2.0]), (3, [2.0, 2.0]), (5, [123456789.015625, 1.0]), (6, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in dual_tree.top_products(df, F.col("vec_id") % 20 == 0, 3).collect()}
    exact = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    want = set()
    for q in (20, 40):
        best = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(exact[q], exact[c])))), c) for c in exact if c != q)[:3]
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert got == want


def test_pairs_are_pruned(spark):
    """Clustered vectors: the bounds leave a part of the pairs of leaves, and the answers are those of brute force."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 8
    rows = np.concatenate([c + rng.normal(size=(60, 16)) * 0.2 for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    report: dict = {}
    got = {tuple(r) for r in dual_tree.top_products(df, F.col("vec_id") % 20 == 0, 20, leaves=24, report=report).collect()}
    assert 0 < report["kept"] < 0.5 * report["pairs"]
    whole = np.floor(64 * rows)
    want = set()
    for q in range(0, len(rows), 20):
        order = sorted((-int(whole[q] @ whole[c]), c) for c in range(len(rows)) if c != q)[:20]
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(order)}
    assert got == want


def test_cover_tree_prunes():
    rng = np.random.default_rng(1)
    centres = np.array([[100.0, 0], [0, 100.0], [-100.0, 0]])
    rows = np.concatenate([c + rng.normal(size=(50, 2)) for c in centres])
    tree = dual_tree.CoverTree(rows, 6)
    leaf, far = tree.file(rows)
    radius = {int(x): float(far[leaf == x].max()) for x in set(leaf)}
    worst = {x: min(np.sort(rows @ q)[-5] for q in rows[leaf == x]) for x in radius}
    kept = set(tree.pairs(radius, worst, radius))
    assert len(kept) < len(radius) ** 2
    for q in range(len(rows)):
        for c in np.argsort(-(rows @ rows[q]))[:5]:
            assert (leaf[q], leaf[c]) in kept


def test_best_cuts():
    rng = random.Random(2)
    for _ in range(200):
        window = rng.choice((8, 16))
        places = np.unique([0, *rng.sample(range(1, 40), rng.randint(3, 12))])
        filled = sorted({int(x) for a, b in zip(places, places[1:]) for x in range(a, b, window)} | {int(x) for x in places})
        costs = [0.0] + [rng.choice((0.0, 2.0, 12.0)) for _ in filled[1:]]
        cuts = packing.best_cuts(np.array(filled), np.array(costs), window, True)

        def cost(cuts):
            out = 0.0
            for a, b in zip(cuts, cuts[1:]):
                n = filled[b] - filled[a]
                power = n & (n - 1) == 0 and n >= packing.LEAST_POWER
                out += costs[b] + packing.OPENING + (0 if power else window - n)
            return out

        best = [0.0] + [math.inf] * (len(filled) - 1)
        for j in range(1, len(filled)):
            for i in range(j):
                if filled[j] - filled[i] <= window:
                    best[j] = min(best[j], best[i] + cost([i, j]))
        assert cost(cuts) == pytest.approx(best[-1]) and cuts[0] == 0 and cuts[-1] == len(filled) - 1


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = collections.defaultdict(list)
    for i, x in pairs(docs):
        texts[i].append(t.encode(x or "", add_special_tokens=False).ids + [0])
    rows = packing.pack(docs, window=64).collect()
    used, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        used[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(used) == set(texts)
    for i, own in used.items():
        assert sum(r["length"] for r in own) == sum(map(len, texts[i]))
        if len(texts[i]) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(texts[i][0])
                assert r["ids_crc32"] == zlib.crc32(np.array(texts[i][0][at : at + r["length"]], "<u4").tobytes())
                at += r["length"]
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert packing.pack(docs.limit(0)).isEmpty()


def test_unit_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    units = packing._tokenizer(None)
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b", " ", "  ", "\n", "é", " ", " ", "😀", "0", ".", "tion", "\t", "<|endoftext|>", "'s", "\x1f", "ß", "Ж"]) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    got = [ids.tolist() for ids, _ in units.encode(pa.array(texts), 0)]
    assert got == [e.ids + [0] for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_units_of_a_whole_table():
    """The ids of all test documents are those of the tokenizer over whole texts."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    column = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).combine_chunks()
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode_batch_fast(column.to_pylist(), add_special_tokens=False)
    units = packing._tokenizer(None)
    assert units.ranks
    for (ids, _), e in zip(units.encode(column, 0), whole, strict=True):
        assert ids.tolist() == e.ids + [0]


def test_interpolation(spark, docs):
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, F.lit(True))
    got = interpolation.score(docs, train).collect()
    tokens = [(i, [*space_words(t), None]) for i, t in pairs(docs)]
    kept = [w for i, w in tokens if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    c = collections.Counter(x for w in kept for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted(((len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for _, w in tokens))
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)
    assert {r["doc_id"]: r["held_out"] for r in got if r["doc_id"] is not None} == {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in tokens if i is not None}
    nothing = interpolation.score(docs, F.lit(False)).collect()
    assert all(r["base_score"] == 0 and abs(r["score"]) < 1e-9 and r["held_out"] for r in nothing)
    assert interpolation.score(docs.limit(0), train).isEmpty()


def interpolated(rows, trained):
    """Plain deleted interpolation over tuples of tokens: scores, and scores with a text's own counts deleted."""
    texts = [[*space_words(t), None] for _, t in rows]
    begin = "<begin>"

    def grams(w):
        return [((x,), (w[k - 1] if k else begin, x), (w[k - 2] if k > 1 else begin, w[k - 1] if k else begin, x)) for k, x in enumerate(w)]

    def contexts(g):
        return (), (g[1][0],), g[2][:2]

    def counts(ws):
        c = collections.Counter()
        for w in ws:
            for g in grams(w):
                c.update(g)
                c[()] += 1
            c.update([(begin,), (begin, begin)])
        return c

    c = counts(w for w, t in zip(texts, trained) if t)
    uniform = 1 / (len({w for w in c if len(w) == 1 and w != (begin,)}) + 1)
    weights = np.zeros((3, interpolation.BUCKETS))

    def bucket(n):
        return min(interpolation.BUCKETS - 1, int(math.log2(n)) + 1) if n > 0 else 0

    def parts(g, less):
        # The first token's trigram has the begin twice before it and counts as its bigram does.
        return [((c[x] - less(x)) / max(c[y] - less(y), 1), c[y] - less(y)) for x, y in zip(g, contexts(g))]

    def probability(f, orders=3):
        p = uniform
        for k in range(orders):
            w = weights[k][bucket(f[k][1])]
            p = w * f[k][0] + (1 - w) * p
        return p

    for order in range(3):
        table = collections.Counter()
        for w, t in zip(texts, trained):
            for g in grams(w) if t else ():
                f = parts(g, lambda x: 1)
                ratio = f[order][0] / probability(f, order)
                top = interpolation.FINE * interpolation.OCTAVES
                table[bucket(f[order][1]), int(np.clip(round(interpolation.FINE * math.log2(ratio)), -top, top)) if ratio > 0 else -top - 1] += 1
        if table:
            keys = np.array(list(table), np.int64)
            weights[order] = interpolation.em(keys[:, 0], keys[:, 1], np.array(list(table.values())))
    out = []
    for w, t in zip(texts, trained):
        own = counts([w]) if t else collections.Counter()
        out.append(tuple(sum(math.log10(probability(parts(g, less))) for g in grams(w)) for less in (lambda x: 0, own.__getitem__)))
    return out


def test_interpolated_scores(spark, docs, monkeypatch):
    """Scores against plain counting, also when blocks are so short that texts go on in others."""
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(30)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice((2, 9, 40)))) for _ in range(25)]
    rows = list(enumerate([*base, *base[:5], None, "", "new words", base[0] + " " + base[1], "w1 w2"]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    trained = [i % 4 != 1 for i, _ in rows]
    want = {i: x for (i, _), x in zip(rows, interpolated(rows, trained))}
    for tokens in (1 << 20, 16):
        monkeypatch.setattr(interpolation, "BLOCK_TOKENS", tokens)
        got = {r["doc_id"]: (r["score"], r["deleted_score"]) for r in interpolation.score(df, F.col("doc_id") % 4 != 1).collect()}
        for i, x in want.items():
            assert got[i][0] == pytest.approx(x[0], rel=1e-6), (tokens, i)
            if tokens > 16 or not trained[i]:
                assert got[i][1] == pytest.approx(x[1], rel=1e-6), (tokens, i)


def test_interpolation_uses_contexts(spark):
    rows = [(i, t) for i, t in enumerate(["a b a c", "a b b", "c a b", "b"] * 5)] + [(100, "a b a c"), (101, "c a a b"), (102, "a b a new")]
    got = {r["doc_id"]: r for r in interpolation.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 100).collect()}
    assert got[100]["score"] > got[101]["score"] > got[102]["score"]
    assert got[100]["base_score"] == pytest.approx(got[101]["base_score"]) and got[100]["score"] > got[100]["base_score"]


def test_expectation_maximisation():
    """Weights go to the estimate that explains the held-out counts."""
    weights = interpolation.em(np.array([1, 2, 3, 0]), np.array([-interpolation.FINE * interpolation.OCTAVES - 1, 640, 0, 640]), np.array([1000, 1000, 1000, 10]))
    assert weights[0] == 0 and weights[1] < 0.01 and weights[2] > 0.99 and 0.4 < weights[3] < 0.6


def test_decontamination(spark, docs):
    rng = random.Random(4)
    base = pairs(docs)
    long = [w for _, t in base for w in alnum_words(t)]
    items = [(k, " ".join(long[a : a + n])) for k, (a, n) in enumerate((rng.randrange(len(long) - 40), rng.choice((1, 3, 9, 10, 11, 25))) for _ in range(25))]
    items += [(100, None), (101, ""), (None, "the of"), (102, items[3][1].upper()), (3, items[3][1])]
    frame = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_hit int")
    want = []
    grams = collections.defaultdict(set)
    for i, t in items:
        w = alnum_words(t)
        if w and i is not None:
            n = min(10, len(w))
            for k in range(len(w) - n + 1):
                grams[tuple(w[k : k + n])].add(i)
    for i, t in base:
        w, hit, found = alnum_words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    found |= grams[g]
                    hit |= set(range(k, k + n))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    got = [tuple(r) for r in phrase_index.decontaminate(docs, frame).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    index = stored(phrase_index.build_index(docs, segment_bytes=500))
    blocked = phrase_index.phrase_hits(index, frame, block_bytes=200)
    assert sorted((r["n_words"], len(r["hits"]), len(r["items"])) for r in blocked.collect()) == sorted(x[1:4] for x in want)
    assert phrase_index.decontaminate(docs.limit(0), frame).isEmpty()
    assert not phrase_index.decontaminate(docs, frame.limit(0)).where("contaminated").count()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha " + "z " * 20 + "beta gamma"), (3, "beta alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "Alpha beta gamma")], "item_id long, text string")
    assert {tuple(r) for r in phrase_index.proximity_hits(phrase_index.build_index(docs), items, 5).collect()} == {(1, "7", 1)}


def test_warc(spark):
    same, small = "s" * 120, "tiny"
    rows = [(3, "http://a/3", same), (1, "http://a/1", same), (2, None, same), (4, "u\r\nX: y", small), (5, "v", small), (6, "w", None), (7, "x", ""), (None, "n", same), (8, "é", "é" * 60), (9, "y", "é" * 60), (1, "http://a/1", same)]
    pages = spark.createDataFrame([(i, u, h, "z") for i, u, h in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min(j for j, _, x in rows if j is not None and x == h) if i is not None and len(b) >= 100 else i
        revisit = i is not None and i > first
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).isEmpty()


def test_warc_ranges_and_record():
    rows = [{"file": f, "offset": o, "length": 10} for f, o in (("a", 0), ("a", 10), ("a", 40), ("b", 0), ("b", 5000))]
    assert [len(g) for g in warc.ranges(rows, gap=25)] == [3, 1, 1]
    import gzip

    got = warc.parsed(gzip.decompress(warc.record(5, "a\nb", b"x\r\n\r\ny", "d", "response", None, "1970-01-01T00:00:00Z")))
    assert got["payload"] == b"x\r\n\r\ny" and got["WARC-Target-URI"] == "a%0Ab" and got["X-Page-ID"] == "5"


def test_suffix_automaton():
    rng = random.Random(9)
    text = bytes(rng.randrange(3) for _ in range(60))
    table = language_id.suffix_automaton(text, 3)

    def accepts(s):
        state = 0
        for c in s:
            state = table[state, c]
            if state < 0:
                return False
        return True

    for _ in range(2000):
        s = bytes(rng.randrange(3) for _ in range(rng.randint(0, 9)))
        assert accepts(s) == (s in text)


def phrases(t, own):
    n = k = 0
    while k < len(t):
        m = k
        while m < len(t) and t[k : m + 1] in own:
            m += 1
        k = max(m, k + 1)
        n += 1
    return n


def test_cross_parsing(monkeypatch):
    """The phrases of plain greedy parsing, however short the segments and whatever form the tables have."""
    rng = random.Random(3)

    def plain(t):
        return re.sub("[^a-zà-ÿ]+", " ", t.lower())

    for segment in (1, 2, 3, 7, 50, 1 << 14):
        monkeypatch.setattr(language_id, "SEGMENT", segment)
        for cells in (0, 300, 1 << 24):
            for _ in range(6):
                samples = {x: "".join(rng.choice(own) for _ in range(rng.randint(1, 60))) for x, own in (("a", "ab "), ("b", "abc"), ("c", "xyz "), ("d", "aé1 "))}
                parser = language_id.CrossParser(samples, cells)
                texts = ["".join(rng.choice(rng.choice(["ab", "abcxyzqé 12", "a"])) for _ in range(rng.randint(0, 120))) for _ in range(8)]
                got = parser.parse(texts)[0]
                assert got.tolist() == [[phrases(plain(t), plain(samples[x])) for t in texts] for x in parser.languages]
    parser = language_id.CrossParser({"a": "banana bandana", "b": "cherry merry"})
    assert parser.predict(["", "123 !", "banana"])[0] == ["und", "und", "a"]


def test_disjoint_alphabets(spark):
    rng = random.Random(2)
    alphabets = [[chr(0x4E00 + 1500 * k + i) for i in range(1500)] for k in range(2)]
    rows = [(i, "".join(rng.choices(alphabets[i % 2], k=60)), "xy"[i % 2]) for i in range(300)]
    got = language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["lang_pred"] == "xy"[r["doc_id"] % 2] for r in held)


def test_every_letter_counts():
    """Samples of many scripts: no letter of theirs is merged, and sorted keys parse as dense tables do."""
    rng = random.Random(8)
    han = [chr(0x4E00 + k) for k in range(900)] + ["\U00020000", "\U00020001"]
    samples = {"l": "".join(rng.choice("abcdefgh ") for _ in range(900)), "c": "".join(rng.choice("абвгдежз ") for _ in range(900)), "x": "".join(rng.choices(han[:450], k=1500)), "y": "".join(rng.choices(han[450:], k=1500))}
    texts = [samples["x"][40:60], samples["y"][40:60], "\U00020000\U00020001", "", "abc где", "".join(rng.choices(han, k=200))]
    parser = language_id.CrossParser(samples)
    assert parser.predict([samples[x][k : k + 12] for x in samples for k in (0, 500)])[0] == [x for x in samples for _ in range(2)]
    for cells in (0, 9000, 200_000):
        other = language_id.CrossParser(samples, cells)
        assert all((a == b).all() for a, b in zip(parser.parse(texts), other.parse(texts), strict=True))
    assert other.dense and other.sparse


def test_language_sample(spark):
    """Up to 400 documents a language with equal shares, not only of the texts' heads."""
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat(repeat('h', 300), repeat(char(97 + id % 7), 1700)) AS text", "'en' AS lang")
    seen = []
    keep = language_id.CrossParser.__init__
    language_id.CrossParser.__init__ = lambda self, samples: seen.append(samples)
    try:
        language_id.fit(docs)
    finally:
        language_id.CrossParser.__init__ = keep
    parts = seen[0]["en"].split("\n")
    assert [len(x) for x in parts] == [100] * 400 and len({x[-1] for x in parts}) == 8 and sum("h" in x for x in parts) < 200


def test_language_id(spark):
    sf = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(sf).withColumn("lang_pred", F.lit(1))
    extra = spark.createDataFrame([(9001, None, "en"), (9002, "12 34", "de"), (None, "the and of", None)], "doc_id long, text string, lang string")
    rows = language_id.language_id(docs.unionByName(extra, allowMissingColumns=True)).collect()
    truth = dict(docs.select("doc_id", "lang").collect())
    known = [r for r in rows if r["doc_id"] in truth]
    held = [r for r in known if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in known)
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.9 * len(held)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (9001, 9002)} == {"und"} and all(0 <= r["score"] <= 1 for r in rows)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.language_id(unlabelled).collect()} == {"und"}
    assert language_id.language_id(docs.limit(0)).isEmpty()


def components(rows):
    sets, inverted, parent = {}, collections.defaultdict(list), {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in rows:
        w = space_words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        parent[i] = i
    for i in sorted(sets):
        for j, n in collections.Counter(j for s in sets[i] for j in inverted[s]).items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            inverted[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base, passage = ([rng.choice(words) for _ in range(n)] for n in (150, 60))
    texts = []
    for _ in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    for _ in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        texts.append(" ".join(w + passage * (rng.random() < 0.5)))
    texts += [rng.choice(texts) for _ in range(30)]
    for _ in range(40):
        w = rng.choice(texts).split()
        k = rng.randrange(len(w))
        w[k : k + rng.randint(0, 3)] = []
        texts.append(" ".join(w))
    texts += [None, "", " \n ", "one two", "One  TWO", "a b c d e", "a b a b a b a b a b"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_shingles int").repartition(3)
    want = components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()} == want
    kept = {r["doc_id"] for r in jaccard_join.first_of_each(df).collect()}
    assert kept == {c for _, c in want.values()}


def test_jaccard_join_edges(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, None), (None, "q"), (8, None)], "doc_id long, text string")
    rows = sorted((tuple(r) for r in jaccard_join.jaccard_components(df).collect()), key=str)
    assert rows == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (7, 0, 7), (None, 1, None), (8, 0, 8)], key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in jaccard_join.first_of_each(df).collect()), key=str) == sorted([(5, "a b c d e f"), (7, None), (8, None), (None, "q")], key=str)
    assert jaccard_join.jaccard_components(df.limit(0)).isEmpty()


def test_shared_stream(spark):
    """Tokens of two classes or more, whatever the batch borders."""
    rng = random.Random(1)
    rows = [(rng.randrange(60), rng.randrange(8), 9) for _ in range(400)] + [(100, k, 9) for k in range(200)] + [(101, 3, 9)] * 50
    df = spark.createDataFrame(rows, "token long, fp long, n int")
    want = collections.defaultdict(set)
    for t, f, _ in rows:
        want[t].add(f)
    want = {(t, f) for t, own in want.items() if len(own) > 1 for f in own}
    for size in (1, 2, 3, 7, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = [(r["token"], r["fp"]) for r in jaccard_join._shared(df).collect()]
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert set(got) == want and len(got) == len(want), size


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(30)] + [(100, 105), (105, 103)] + [(200 + rng.randrange(20), 200 + rng.randrange(20)) for _ in range(12)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in jaccard_join.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_license_scan(spark, docs):
    notice = license_scan.TEMPLATES[1][1]
    extra = [(200, "Under the MIT License. under the mit license\nApache License, Version 2.0 CC BY-NC"), (201, notice), (202, notice.replace("hereby ", "") + " extra"), (203, " ".join(notice.split()[:8])), (204, "under\nthe mit\nlicense"), (205, "underthe mit license cc-by_nc4"), (206, "all rights\nreserved"), (207, "All rights reserved.")]
    lines = notice.split()
    extra += [(208, "\n".join(" ".join(lines[k : k + 7]) for k in range(0, len(lines), 7))), (209, " ".join(lines[:10]) + "\n" + "x" * 130 + "\n" + " ".join(lines[10:])), (210, " ".join(lines[:12]) + "\n" + " ".join(lines[12:]) + " " + "y" * 100), (211, "\n".join(lines))]
    df = docs.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(i, t, 1) for i, t in extra], "doc_id long, text string, score int"))
    templates = [(label, set(license_scan._words(t))) for label, t in license_scan.TEMPLATES]
    want = []

    def blocks(text):
        lines = text.split("\n")
        for i in range(len(lines)):
            n = 1
            while n < license_scan.SPAN and i + n < len(lines) and all(len(x) <= license_scan.WRAP for x in lines[i : i + n + 1]):
                n += 1
            yield "\n".join(lines[i : i + n])

    for i, t in pairs(df):
        w = alnum_words(t)
        places = [(k, label) for phrase, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        found = {label: len(words & set(alnum_words(line))) / len(words) for line in blocks(t or "") for label, words in templates if len(words & set(alnum_words(line))) >= math.ceil(0.8 * len(words) - 1e-9)}
        best = max((len(words & set(alnum_words(line))) / len(words) for line in blocks(t or "") for _, words in templates if len(words & set(alnum_words(line))) >= math.ceil(0.8 * len(words) - 1e-9)), default=0.0)
        at = [k for k, _ in places]
        base = {label for _, label in places}
        want.append((i, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), 1.0 if places else best))
    got = [tuple(r) for r in license_scan.scan(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    labels = {r[0]: r[6] for r in got}
    assert labels[206] == "all-rights-reserved" and labels[208] == "mit" and labels[209] == labels[210] == labels[211] == ""
    assert license_scan.scan(df.limit(0)).isEmpty()


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits))) or (k == 3 and not 10 <= len(digits) <= 15):
                continue
            out.append(pii.Span(m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s.start, s.kind))


def test_base_spans():
    rng = random.Random(3)
    for _ in range(8000):
        t = "".join(rng.choice("ab@@..1234  +-()0x٣") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t), t
    for t in ("1" * 100_000, "a" * 100_000, "@" * 50_000, "+1" + " " * 50_000, "1." * 50_000, "a@" * 20_000):
        pii.base_spans(t)
        pii.nodes(t)
    assert pii.base_spans("x@y.z 4433-7166 9846 4399 2 1.2.3.256")[0] == (0, 5, 0)


def test_skip_chain():
    """A number without its prefix is a phone because the document has it with the prefix elsewhere."""
    rng = random.Random(6)
    texts = []
    for _ in range(300):
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04d}"
        texts.append(f"call {phone} or mail ab{rng.randint(1, 99)}@x{rng.randint(1, 9)}.com, paid {rng.randint(1, 999)} for {rng.randint(1000000, 9999999)} pieces")
    crf = pii.SkipChainCRF.fit(texts)
    [(base, added)] = pii.found(["call +1 (884) 555-0549 now, later (884) 555-0549 again"], crf)
    assert [s.kind for s in base] == [3] and pii.Span(34, 48, 3) in added
    [(base, added)] = pii.found(["we sold 1234567 pieces for 12 in 2024"], crf)
    assert not base and not added
    assert pii.found(["", "nothing"], pii.SkipChainCRF.fit([])) == [([], []), ([], [])]


@pytest.fixture(scope="module")
def field():
    """Trained on texts whose personal data all match the base patterns."""
    rng = random.Random(4)
    words = "the meeting was held in town and people came to see what had been made there for all".split()
    texts = []
    for _ in range(400):
        parts = [rng.choice(words) for _ in range(12)]
        parts.insert(5, rng.choice((f"+1 ({rng.randint(200, 999)}) {rng.randint(100, 999)}-{rng.randint(0, 9999):04d}", f"{rng.choice(words)}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4)), card(rng), f'token = "{rng.getrandbits(160):040x}"', str(rng.randint(10**15, 10**16 - 1)), "Version 2.0.")))
        texts.append(" ".join(parts))
    return pii.SkipChainCRF.fit(texts), words


def card(rng):
    first = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(first + str(c) for c in range(10) if pii.luhn(first + str(c)))


def test_added_spans(field):
    """What the base patterns miss is found; other numbers are left alone."""
    crf, words = field
    rng = random.Random(9)

    def caught(x):
        text = f"{' '.join(rng.choice(words) for _ in range(6))} {x} {' '.join(rng.choice(words) for _ in range(6))}."
        [(base, added)] = pii.found([text], crf)
        a = text.index(x)
        return bool(added), any(s.start < a + len(x) and a < s.end for s in base + added)

    def number():
        return f"{rng.randint(200, 999)}", f"{rng.randint(100, 999)}", f"{rng.randint(0, 9999):04d}"

    for make in (lambda: "({}) {}-{}".format(*number()), lambda: "{}-{}-{}".format(*number()), lambda: "{} {} {}".format(*number()), lambda: "jo{} at mail dot org".format(rng.randint(1, 99)), lambda: "{}[at]mail[dot]org".format(rng.choice(words)), lambda: (c := card(rng)) and ".".join(c[k : k + 4] for k in (0, 4, 8, 12)), lambda: " ".join([card(rng)] * 2), lambda: f'api_key: "{rng.getrandbits(160):040x}"'):
        hits = [caught(make())[1] for _ in range(60)]
        assert sum(hits) >= 54, make()
    for make in (lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"${rng.randint(1, 9999)}.{rng.randint(0, 99):02d}", lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", lambda: str(rng.randint(0, 10**6)), lambda: f"{rng.randint(0, 23)}:{rng.randint(0, 59):02d}", lambda: f"{rng.randint(1, 99)},{rng.randint(0, 999):03d},{rng.randint(0, 999):03d}"):
        assert not any(caught(make())[0] for _ in range(60)), make()


def test_messages_against_enumeration(field):
    """Marginals on chains are exact; with loops they are close."""
    import itertools

    crf, _ = field
    rng = np.random.default_rng(1)
    k = len(pii.LABELS)
    for chain, skip, tolerance in (([(0, 1), (1, 2)], [], 1e-3), ([(0, 1)], [(1, 3), (3, 2)], 1e-3), ([(0, 1), (1, 2)], [(0, 2)], 0.2)):
        n = 4
        score = rng.normal(size=(n, k))
        chain, skip = (np.array(x, np.int64).reshape(-1, 2) for x in (chain, skip))
        got = crf.propagated(score, chain, skip)
        want = np.zeros((n, k))
        for y in itertools.product(range(k), repeat=n):
            w = math.exp(sum(score[i, y[i]] for i in range(n)) + sum(crf.chain[y[a], y[b]] for a, b in chain) + sum(crf.skip[y[a], y[b]] for a, b in skip))
            for i in range(n):
                want[i, y[i]] += w
        want /= want.sum(axis=1, keepdims=True)
        assert np.abs(got - want).max() < tolerance


def test_many_matches(field):
    """Time is linear in a text's matches."""
    import time

    crf, _ = field
    took = []
    for n in (2000, 16000):
        text = " ".join(f"ab{i}@x{i % 7}.com" for i in range(n))
        began = time.time()
        [(base, added)] = pii.found([text], crf)
        took.append(time.time() - began)
        assert len(base) == n and not added
    assert took[1] < 30 * took[0] + 1


def test_personal_data(spark, docs):
    extra = spark.createDataFrame([(300, "é a.b@c.de, +1 (884) 555-0549 1.2.3.4 and 4337 1665 9846 4399"), (301, None)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(extra).withColumn("spans", F.lit(1))
    rows = pii.personal_data(df).collect()
    want = []
    for i, t in pairs(df):
        spans = plain_spans(t or "")
        want.append((i, *(sum(s.kind == k for s in spans) for k in range(4)), hashlib.sha256(",".join(f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in spans).encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in rows), key=str) == sorted(want, key=str)
    for r in rows:
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] <= len(r["spans"].split(",")) if r["spans"] else True
    assert pii.masked("x a@b.c y", [pii.Span(2, 7, 0)]) == "x [EMAIL] y"
    assert pii.personal_data(df.limit(0)).isEmpty()
