import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill import queries
from textmill.functions import text as T
from textmill.operators import crawl, evaluate, index, matching, scoring, summarize, tolerant, vector
from textmill.operators.expand import expanded


@pytest.fixture(scope="module")
def toy(spark):
    posts = spark.createDataFrame([("x", 1, 1), ("x", 2, 1), ("y", 1, 1), ("y", 3, 1), ("z", 2, 1)], "term string, doc_id long, tf long")
    lengths = spark.createDataFrame([(1, 20), (2, 15), (3, 10)], "doc_id long, dl long")
    return scoring.Index(posts, index.term_stats(posts), lengths, index.corpus_stats(lengths))


@pytest.fixture(scope="module")
def xyz(spark):
    return spark.createDataFrame([(1, "x", 1), (1, "y", 1), (1, "z", 1), (1, "unknown", 2)], "query_id long, term string, qtf long")


def scores(df):
    return {r["doc_id"]: r["score"] for r in df.collect()}


def test_cosine_and_bm25(toy, xyz):
    got = scores(scoring.cosine(xyz, toy))
    assert got == pytest.approx({1: 0.0031008, 2: 0.0172435, 3: 0.0031008}, abs=1e-6)
    got = scores(scoring.bm25(xyz, toy))
    assert got == pytest.approx({1: 0.3099206, 2: 0.6532125, 3: 0.2038951}, abs=1e-6)
    assert [r["doc_id"] for r in scoring.top_k(scoring.cosine(xyz, toy), 3).orderBy("rank").collect()] == [2, 1, 3]


def test_candidates_and_every_doc(spark, toy, xyz):
    few = spark.createDataFrame([(1, 3), (1, 1)], "query_id long, doc_id long")
    only_z = xyz.where("term = 'z'")
    assert scores(scoring.cosine(only_z, toy, few)) == {1: 0.0, 3: 0.0}
    assert set(scores(scoring.bm25(only_z, toy, every_doc=True))) == {1, 2, 3}
    assert set(scores(scoring.bm25(only_z, toy))) == {2}


def test_language_models(spark, toy):
    q = spark.createDataFrame([(1, "x", 1), (1, "z", 3), (2, "x", 1), (2, "unknown", 1)], "query_id long, term string, qtf long")
    cands = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "query_id long, doc_id long")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in scoring.language_model(q, cands, toy).collect()}
    assert got[1, 2] == pytest.approx((1.1 / 15.3) ** 2) and got[1, 1] == pytest.approx(1.1 / 20.3 * 0.1 / 20.3) and got[2, 1] == 0
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in scoring.language_model(q, cands, toy, "jelinek-mercer", 0.8).collect()}
    assert got[1, 2] == pytest.approx((0.8 / 15 + 0.2 * 2 / 45) * (0.8 / 15 + 0.2 * 1 / 45))
    with pytest.raises(ValueError):
        scoring.language_model(q, cands, toy, "other")
    cats = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "category string, doc_id long")
    got = {(r["query_id"], r["category"]): r["score"] for r in scoring.category_language_model(q, cats, toy).collect()}
    assert got[1, "a"] == pytest.approx(2.1 / 35.3 * 1.1 / 35.3) and got[2, "a"] == 0


def naive_cascade(q, posts, tier, least):
    known = {t for t, _, _ in posts}
    q = {t: n for t, n in q.items() if t in known}
    if not q:
        return set(), 0
    sets = [lambda t, n: {d for x, d, f in posts if x == t and f >= n and f >= tier}, lambda t, n: {d for x, d, f in posts if x == t and f >= n}]
    stages = [set.intersection(*(s(t, n) for t, n in q.items())) for s in sets]
    stages += [{d for x, d, f in posts if x in q and f >= tier}, {d for x, d, f in posts if x in q}]
    for k, s in enumerate(stages, 1):
        if len(s) >= least:
            return s, k
    return set(), 0


def test_cascade(spark):
    posts = [("a", 1, 5), ("a", 2, 1), ("a", 3, 6), ("b", 1, 7), ("b", 2, 2), ("b", 4, 1), ("c", 5, 9)]
    tiered = index.tiered(spark.createDataFrame(posts, "term string, doc_id long, tf long"), 5)
    asked = {1: {"a": 1, "b": 1}, 2: {"a": 2}, 3: {"b": 2, "zz": 1}, 4: {"zz": 1}, 5: {"c": 1}}
    q = spark.createDataFrame([(i, t, n) for i, own in asked.items() for t, n in own.items()], "query_id long, term string, qtf long")
    for least in (1, 2, 3, 9):
        rows = matching.cascade(q, tiered, least).collect()
        for i, own in asked.items():
            got = {r["doc_id"] for r in rows if r["query_id"] == i}, max([r["stage"] for r in rows if r["query_id"] == i], default=0)
            assert got == naive_cascade(own, posts, 5, least), (i, least)
    both, any_ = ({tuple(r) for r in f(q, tiered).collect()} for f in (matching.conjunctive, matching.disjunctive))
    assert both <= any_ and (1, 1) in both and (1, 3) not in both


def test_wildcards(spark):
    words = "lorem ipsum dolor sit amet dolore labore quis qui aliquip cupidatat voluptate magna ut".split()
    vocab = spark.createDataFrame([(w, 1) for w in words], "word string, freq long")
    patterns = spark.createDataFrame([("*ore",), ("*qui*",), ("*up*ta*",)], "pattern string")
    grams = index.kgram_index(vocab, 2)
    got = {}
    for r in tolerant.wildcard_options(patterns, grams, 2).collect():
        got.setdefault(r["pattern"], set()).add(r["word"])
    assert got == {"*ore": {"dolore", "labore"}, "*qui*": {"aliquip", "qui", "quis"}, "*up*ta*": {"cupidatat", "voluptate"}}
    assert {r["word"] for r in tolerant.sequential_options(patterns.where("pattern = '*ore'"), grams, 2).collect()} == {"dolore", "labore"}


def test_repair(spark):
    vocab = spark.createDataFrame([("dolore", 5), ("dolare", 5), ("dolire", 1), ("sit", 2)], "word string, freq long")
    words = spark.createDataFrame([(1, 0, "dol*re"), (1, 1, "sit"), (2, 0, "nothing")], "query_id long, pos int, word string")
    rows = tolerant.repaired(words, vocab, index.kgram_index(vocab, 2), 2).collect()
    assert {(r["query_id"], r["pos"]): r["repaired"] for r in rows} == {(1, 0): "dolare", (1, 1): "sit", (2, 0): "nothing"}


def test_collocations(spark):
    words = ["a", "b"] * 3 + ["c", "d", "e"] * 2 + ["a"]
    lists = spark.createDataFrame([(1, words)], "doc_id long, words array<string>")
    got = {r["gram"]: r["pmi"] for r in index.collocations(lists, 2, 0.0, 2).collect()}
    assert got["a b"] == pytest.approx(math.log2(3 * 13) - math.log2(4 * 3))
    got = {r["gram"]: r["pmi"] for r in index.collocations(lists, 2, 0.0, 3).collect()}
    assert got["c d e"] == pytest.approx(math.log2(2 * 13 * 13) - math.log2(8))
    assert index.collocations(lists, 1, 0.0, 4).isEmpty()
    docs = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, ["a", "b"])], "doc_id long, words array<string>")
    stats = index.ngram_stats(index.ngram_index(docs, spark.createDataFrame([("a b", 2)], "gram string, n int"))).first()
    assert (stats["df"], stats["occurrences"]) == (2, 3)


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 20)], "query_id long, rank int, doc_id long")
    qrels = spark.createDataFrame([(1, 10, 1), (1, 12, 4), (1, 99, 2), (2, 77, 1)], "query_id long, doc_id long, grade int")
    assert evaluate.mean_average_precision(ranked, qrels).first()["map"] == pytest.approx((1 + 2 / 3) / 2 / 2)
    dcg = 15 / 1 + 1 / 2
    ideal = 15 / 1 + 7 / math.log2(3) + 1 / 2
    assert evaluate.ndcg(ranked, qrels, 3).first()["ndcg"] == pytest.approx(dcg / ideal / 2)
    points = {r["level"]: r["precision"] for r in evaluate.eleven_points(ranked, qrels).collect()}
    assert points[0.0] == pytest.approx(0.5) and points[0.30000000000000004] == pytest.approx(1.0) and points[0.9999999999999999] is None
    assert {r["query_id"]: r["recall"] for r in evaluate.recall(ranked, qrels).collect()} == {1: 0.667, 2: 0.0}


def test_rocchio(spark):
    dw = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "b", 3.0), (3, "c", 4.0)], "doc_id long, term string, w double")
    qw = spark.createDataFrame([(1, "a", 1.0), (2, "c", 1.0)], "query_id long, term string, w double")
    rel = spark.createDataFrame([(1, 1)], "query_id long, doc_id long")
    n = spark.createDataFrame([(3,)], "n_docs long")
    got = {(r["query_id"], r["term"]): r["w"] for r in vector.rocchio(qw, rel, dw, n).collect()}
    assert got == pytest.approx({(1, "a"): 1 + 0.5 * 2, (1, "b"): 0.5 - 0.15 * 3 / 2, (2, "c"): 1 - 0.15 * 4 / 3})
    assert scores(vector.similarity(qw.where("query_id = 1"), dw)) == pytest.approx({1: 2 / math.sqrt(5)})


def test_crawl(spark):
    def page(*links):
        return "".join(f'<a class="x" href="{x}">.</a>' for x in links)

    pages = spark.createDataFrame([(1, "http://s/a", page("b", "/c", "http://s/a")), (2, "http://s/b", page("c", "d")), (3, "http://s/c", page("d") + "needle"), (4, "http://s/d", page("e"))], "page_id long, url string, html string")
    rows = [(r["level"], r["page_id"], r["found"]) for r in crawl.crawl(pages, "http://s/a", 10, "needle").orderBy("level", "ord").collect()]
    assert rows == [(0, 1, False), (1, 2, False), (1, 3, True), (2, 4, False)]
    assert crawl.crawl(pages, "http://s/a", 2).count() == 2
    assert [r["url"] for r in crawl.frontier(pages).collect()] == ["http://s/e"]
    assert [r["page_id"] for r in crawl.containing(pages, "needle").collect()] == [3]


def test_summaries_of_large_matrices():
    """Entries and blocks give the sentences that whole matrices give (of rank two at least: else any second vector will do)."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(40)]
    vectors = {w: rng.normal(size=5) for w in words}
    for n in (12, 90, 300):
        for _ in range(8):
            sentences = [[words[int(i)] for i in rng.zipf(1.5, size=rng.integers(0, 9)) if i < 40] for _ in range(n)]
            assert summarize.lsa_pick(sentences, 0) == summarize.lsa_pick(sentences)
            assert summarize.textrank_pick(sentences, vectors, 5, cells=7 * n) == summarize.textrank_pick(sentences, vectors, 5)


def test_summaries_rank_whole_documents(spark):
    rng = np.random.default_rng(3)
    text = " ".join(f"marker {' '.join(f'w{chr(97 + i)}' for i in rng.integers(0, 26, 5))}." for _ in range(2300))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert summarize.lsa_summaries(docs).first()["summary"].count("marker") == 2
    table = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(9)], "vec_id long, embedding array<float>")
    assert summarize.textrank_dealt(docs, table).first()["summary"].count("marker") == 2


def test_textrank_knows_every_word(spark, tmp_path):
    """Words that occur once have vectors too."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(16, 4)).astype("float32")
    words = [["alpha", "beta"], ["gamma", "delta"], ["epsilon", "zeta"], ["theta", "iota"], ["kappa", "omega"]]
    raw = [" ".join(s) + "." for s in words]
    spark.createDataFrame([(1, " ".join(raw))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    own = {w: vectors[zlib.crc32(w.encode()) % 16] for s in words for w in s}
    picked = summarize.textrank_pick(words, own, 4)
    assert picked != summarize.textrank_pick(words, {}, 4)
    assert queries.textrank_summary(spark, str(tmp_path)).first()["summary"] == ".".join(raw[i] for i in picked)


def test_expansion(spark):
    words = spark.createDataFrame([(1, "car")], "query_id long, word string")
    lex = spark.createDataFrame([("car", 0, "hypernym", "motor_vehicle"), ("car", 1, "hyponym", "cab"), ("car", 2, "hypernym", "late"), ("car", 0, "synonym", "auto")], "word string, sense_rank int, relation string, lemma string")
    assert {r["word"] for r in expanded(words, lex).collect()} == {"car", "motor", "vehicle", "cab"}


def test_index_lengths_and_limit(spark):
    docs = spark.createDataFrame([(1, "the cat the cat sat"), (2, "of the"), (3, None), (4, "cat")], "doc_id long, text string")
    built = scoring.build(docs)
    assert {r["doc_id"]: r["dl"] for r in built.doc_len.collect()} == {1: 3, 2: 0, 3: 0, 4: 1}
    assert {r["line"] for r in index.index_lines(built.postings).collect()} == {"cat 1 2 4 1", "sat 1 1"}
    assert index.limited(docs, 0).isEmpty() and index.limited(docs, 2).count() == 2
    assert vector.id_range(docs, 2, 4).agg(F.collect_set("doc_id")).first()[0] == [0, 1]


def plain_lsa(sentences):
    """Term shares by sentence times ln(n / df), whole decomposition, two strongest sentences."""
    n = len(sentences)
    if n <= 2:
        return list(range(n))
    everything = [w for s in sentences for w in s]
    words = sorted({w for w in everything if everything.count(w) > 1})
    if not words:
        return [0, 1]
    a = np.array([[s.count(w) for s in sentences] for w in words], float)
    for j in range(n):
        if a[:, j].sum():
            a[:, j] /= a[:, j].sum()
    a *= np.array([math.log(n / sum(w in s for s in sentences)) for w in words])[:, None]
    v = np.abs(np.linalg.svd(a)[2]).round(9)
    first = int(v[0].argmax())
    second = v[1].copy()
    second[first] = -1
    return [first, int(second.argmax())]


def test_lsa_against_plain_matrices():
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(25)]
    shares = 0
    for _ in range(150):
        sentences = [[words[int(i) % 25] for i in rng.zipf(1.4, size=rng.integers(1, 12))] for _ in range(rng.integers(1, 14))]
        assert summarize.lsa_pick(sentences) == plain_lsa(sentences), sentences
        shares += len({len(s) for s in sentences}) > 1
    assert shares > 100  # sentences of different lengths, where shares and counts differ


def test_textrank_against_a_linear_system():
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(30)]
    vectors = {w: rng.normal(size=6) for w in words}
    seen = 0
    for _ in range(80):
        sentences = [[words[i] for i in rng.integers(0, 30, rng.integers(1, 8))] for _ in range(rng.integers(3, 12))]
        x = np.array([sum(vectors[w] for w in s) / (len(s) + 0.001) for s in sentences])
        x /= np.linalg.norm(x, axis=1)[:, None]
        w = np.clip(x @ x.T, 0, None)
        np.fill_diagonal(w, 0)
        n, out = len(w), w.sum(axis=1)
        move = np.where(out[:, None] > 0, w / np.where(out > 0, out, 1)[:, None], 1 / n)
        rank = np.linalg.solve(np.eye(n) - 0.85 * move.T, np.full(n, 0.15 / n))
        order = np.argsort(-rank)
        if rank[order[0]] - rank[order[1]] > 1e-4 and rank[order[1]] - rank[order[2]] > 1e-4:
            seen += 1
            assert summarize.textrank_pick(sentences, vectors, 6) == order[:2].tolist()
    assert seen > 40


def test_textrank_with_word_vectors(spark):
    """Joined vectors give what vectors at hand give; documents without sentences have an empty summary."""
    raw = ["Cats purr loudly.", "Dogs bark.", "Cats and dogs sleep.", "Nothing else happens here."]
    docs = spark.createDataFrame([(1, " ".join(raw)), (2, ""), (3, "One.")], "doc_id long, text string")
    rng = np.random.default_rng(1)
    known = {w: rng.normal(size=3).tolist() for w in ("cats", "purr", "dogs", "bark", "sleep")}
    table = spark.createDataFrame(list(known.items()), "word string, vec array<double>")
    got = {r["doc_id"]: r["summary"] for r in summarize.textrank_summaries(docs, table).collect()}
    words = [["cats", "purr", "loudly"], ["dogs", "bark"], ["cats", "dogs", "sleep"], ["nothing", "else", "happens", "here"]]
    picked = summarize.textrank_pick(words, {w: np.array(v) for w, v in known.items()}, 3)
    assert got == {1: ".".join(raw[i] for i in picked), 2: "", 3: "One."}


def test_stemmed_terms(spark):
    from textmill.functions.porter import stem

    docs = spark.createDataFrame([(1, "Running runners ran the races"), (2, None), (3, ""), (4, "races running and running")], "doc_id long, text string")
    got = {(r["doc_id"], r["pos"], r["term"]) for r in index.terms_of(docs, stemmed=True).collect()}
    want = {(r["doc_id"], r["pos"], stem(r["term"])) for r in index.terms_of(docs).collect()}
    assert got == want and (4, 3, "run") in got


@pytest.fixture(scope="module")
def blanks(spark, tmp_path_factory):
    """Documents without any sentence beside others."""
    path = str(tmp_path_factory.mktemp("blanks"))
    spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "One"), (5, "One two. Two three.")], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_rouge1_of_blank_documents(spark, blanks):
    assert {r["doc_id"]: r["rouge1"] for r in queries.rouge1(spark, blanks).collect()} == {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.5}


def test_summary_scores_of_blank_documents(spark, blanks):
    assert {r["doc_id"]: r["rouge1"] for r in queries.summary_scores(spark, blanks).collect()} == {1: 0.0, 2: 0.0, 3: 0.0, 4: 1.0, 5: 1.0}


def test_summary_report_of_blank_documents(spark, blanks):
    assert [tuple(r) for r in queries.summary_report(spark, blanks).select("method", "n", "rouge1").collect()] == [("lead", 5, 0.1)]


def test_postings_are_counted_within_documents(spark):
    """No shuffle, as the plan shows; documents that share an id are still one."""
    docs = spark.createDataFrame([(1, "b a b. The b, aa"), (2, None), (3, ""), (4, "Élan élan ab a")], "doc_id long, text string")
    got = index.doc_postings(docs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {("b", 1, 3), ("aa", 1, 1), ("élan", 4, 2), ("ab", 4, 1)}
    for more in ({"stemmed": True}, {"analyzer": T.treebank_tokens}, {"stop": ("b",)}):
        assert {tuple(r) for r in index.doc_postings(docs, **more).collect()} == {tuple(r) for r in index.postings(index.terms_of(docs, **more)).collect()}
    twice = docs.unionByName(spark.createDataFrame([(1, "b " * 50000)], "doc_id long, text string"))
    assert {tuple(r) for r in index.doc_postings(twice).collect()} == {tuple(r) for r in index.postings(index.terms_of(twice)).collect()}
    built = scoring.build(twice)
    assert sorted(tuple(r) for r in built.doc_len.collect()) == [(1, 50004), (1, 50004), (2, 0), (3, 0), (4, 3)]


def test_shared_sums_in_blocks(spark, monkeypatch):
    """Blocks of queries, large documents and pruning give what plain sums give."""
    from textmill.operators import products

    rng = np.random.default_rng(8)
    left = {(int(q), f"t{t}"): int(w) for q, t, w in zip(rng.integers(0, 9, 90), rng.integers(0, 30, 90), rng.integers(1, 9, 90), strict=True)}
    right = {(int(d), f"t{t}"): int(x) for d, t, x in zip(rng.integers(0, 40, 900), rng.integers(0, 35, 900), rng.integers(1, 9, 900), strict=True)}
    want = {}
    for (q, t), w in left.items():
        for (d, u), x in right.items():
            if t == u:
                want[q, d] = want.get((q, d), 0) + w * x
    lf = spark.createDataFrame([(q, t, w) for (q, t), w in left.items()], "query_id long, term string, w long")
    rf = spark.createDataFrame([(d, t, float(x)) for (d, t), x in right.items()], "doc_id long, term string, x double")
    product = lambda w, x, _: (w * x,)
    for entries in (1, 20, 1 << 20):
        got = products.shared_sums(lf, rf, ["s"], product, entries=entries)
        assert {(r["query_id"], r["doc_id"]): r["s"] for r in got.collect()} == want
    few = products.shared_sums(lf, rf, ["score"], product, final=lambda s, _, w: s, best=(3, 0))
    top = scoring.top_k(spark.createDataFrame([(q, d, float(s)) for (q, d), s in want.items()], "query_id long, doc_id long, score double"), 3, 0)
    assert sorted(map(tuple, scoring.top_k(few, 3, 0).collect())) == sorted(map(tuple, top.collect()))
    assert few.count() < len(want)


def test_sequential_fold(spark):
    """The fold over lists of words in memory, with an intersection that runs empty on the way."""
    words = ["dolore", "labore", "aliquip", "qui", "quis", "cupidatat", "voluptate", "ab", "cd", "abxx", "zz"]
    grams = spark.createDataFrame([(f"${w}$"[i : i + 2], w) for w in words for i in range(len(w) + 1)], "gram string, word string")
    lists = {}
    for g, w in grams.collect():
        lists.setdefault(g, set()).add(w)
    patterns = ["*ore", "*qui*", "*up*ta*", "ab*cd", "abcd*", "zq*ab", "q*zz", "nothing*"]
    want = set()
    for p in patterns:
        acc: set = set()
        padded = f"${p}$"
        for g in (padded[i : i + 2] for i in range(len(padded) - 1)):
            if "*" not in g and g in lists:
                acc = acc & lists[g] if acc else set(lists[g])
        want |= {(p, w) for w in acc}
    got = {tuple(r) for r in tolerant.sequential_options(spark.createDataFrame([(p,) for p in patterns], "pattern string"), grams, 2).collect()}
    assert got == want


def test_index_follows_the_table(spark, tmp_path):
    """A table that is written anew has a new index."""
    path = f"{tmp_path}/documents.parquet"
    for text in ("one two", "three three"):
        spark.createDataFrame([(1, text)], "doc_id long, text string").write.mode("overwrite").parquet(path)
        assert {r["term"] for r in queries.inverted_index(spark, str(tmp_path)).collect()} == set(text.split())
