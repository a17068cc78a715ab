import json
import time

from textmill.operators import index, scoring
from textmill.plans import engine
from textmill.sources import readers, writers
from textmill.streaming.indexing import index_stream

SGML = """<!DOCTYPE x>
<REUTERS TOPICS="YES" NEWID="1"><TOPICS><D>cocoa</D><D>grain</D></TOPICS><PLACES><D>usa</D></PLACES>
<TEXT><TITLE>CAF\xc9 &lt;X></TITLE><BODY>First body &amp; more.</BODY></TEXT></REUTERS>
<REUTERS NEWID="2"><PLACES><D>usa</D></PLACES><TEXT><BODY>No title.</BODY></TEXT></REUTERS>
"""


def test_articles(spark, tmp_path):
    (tmp_path / "reut2-000.sgm").write_bytes(SGML.encode("latin-1"))
    rows = {r["newid"]: r for r in readers.articles(spark, str(tmp_path / "reut2-[0-9][0-9][0-9]*")).collect()}
    assert rows[1]["title"] == "CAFÉ <X>" and rows[1]["body"] == "First body & more." and rows[1]["tags"] == ["cocoa", "grain", "usa"]
    assert rows[2]["text"] == "\nNo title."
    cats = {tuple(r) for r in readers.article_categories(readers.articles(spark, str(tmp_path))).collect()}
    assert cats == {("cocoa", 1), ("grain", 1), ("usa", 1), ("usa", 2)}


def test_descriptions(spark, tmp_path):
    path = tmp_path / "cat.txt"
    path.write_text("** header (X)\n@ skip (Y)\nMoney/Foreign Exchange (MONEY-FX)\nOld (SHIP)\nShipping (SHIP) more (Z)\nTwo words (A B)\n (EMPTY)\n")
    assert {tuple(r) for r in readers.category_descriptions(spark, str(path)).collect()} == {("money-fx", "Money/Foreign Exchange"), ("ship", "Shipping"), ("empty", "")}


def test_judged_collection(spark, tmp_path):
    for name, rows in (("d", [{"id": 1, "body": "x"}]), ("q", [{"query number": 3, "query": "y"}]), ("r", [{"query_num": "3", "id": "1", "position": 2}])):
        (tmp_path / name).write_text(json.dumps(rows))
    docs, queries, qrels = readers.judged_collection(spark, *(str(tmp_path / n) for n in "dqr"))
    assert tuple(docs.first()) == (1, "x") and tuple(queries.first()) == (3, "y") and tuple(qrels.first()) == (3, 1, 2)


def test_opinions_and_vectors(spark, tmp_path):
    (tmp_path / "topics").mkdir()
    (tmp_path / "topics/radio.txt.data").write_text("Good radio.")
    (tmp_path / "summaries-gold/radio").mkdir(parents=True)
    (tmp_path / "summaries-gold/radio/radio.1.txt").write_text("Good.")
    texts, golds = readers.opinions(spark, str(tmp_path))
    assert tuple(texts.first()) == ("radio", "Good radio.") and tuple(golds.first()) == ("radio", 1, "Good.")
    (tmp_path / "v.txt").write_text("cat 0.5 1\n")
    assert tuple(readers.word_vectors(spark, str(tmp_path / "v.txt")).first()) == ("cat", [0.5, 1.0])


def test_index_round_trips(spark, tmp_path):
    docs = spark.createDataFrame([(1, "cat sat cat"), (2, "été cat")], "doc_id long, text string")
    built = scoring.build(docs)
    for _ in range(2):  # writing again replaces
        writers.text_index(built.postings, str(tmp_path / "text"))
        writers.index(built, str(tmp_path / "index"))
    want = {tuple(r) for r in built.postings.select("term", "doc_id", "tf").collect()}
    assert {tuple(r) for r in readers.index_lines(spark, str(tmp_path / "text")).collect()} == want
    again = readers.stored_index(spark, str(tmp_path / "index"))
    assert {tuple(r) for r in again.postings.select("term", "doc_id", "tf").collect()} == want and again.stats.first()["n_docs"] == 2
    writers.summary_report(spark.createDataFrame([(1, "lsa", 0.5, "s", "g")], "doc_id long, method string, rouge1 double, summary string, gold string"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/averages")).first()["rouge1"] == 0.5


def test_answers(spark):
    docs = spark.createDataFrame([(1, "Cats sleep. Dogs bark. Cats purr."), (2, "Dogs run."), (3, "Nothing here.")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "cats purr"), (2, "d*gs")], "query_id long, text string")
    rows = engine.answers(queries, docs, 2, repair=True, k=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in rows] == [(1, 1), (2, 2), (2, 1)]
    assert "<em>purr</em>" in rows[0]["highlighted"] and rows[0]["summary"]
    rows = engine.answers(queries, docs, 1, tier=2, scorer=scoring.cosine).collect()
    assert {(r["query_id"], r["doc_id"]) for r in rows} == {(1, 1)}


def test_long_index_lines(spark, tmp_path):
    """The time of a line grows with its length, not with the square of it."""
    n = 60000
    (tmp_path / "line.txt").write_text("term " + " ".join(f"{i} {i % 7}" for i in range(n)) + "\n")
    began = time.time()
    total = readers.index_lines(spark, str(tmp_path)).selectExpr("count(*)", "sum(doc_id)", "sum(tf)", "count(distinct term)").first()
    assert tuple(total) == (n, n * (n - 1) // 2, sum(i % 7 for i in range(n)), 1)
    assert time.time() - began < 30


def test_answers_are_ranked_by_rounded_scores(spark):
    docs = spark.createDataFrame([(1, "cats"), (2, "cats"), (3, "dogs")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "cats")], "query_id long, text string")

    def scorer(q, tables, candidates=None, best=None):
        return spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.50000001)], "query_id long, doc_id long, score double")

    for tier in (None, 1):
        rows = engine.answers(queries, docs, 1, scorer=scorer, tier=tier, digits=6).collect()
        assert [(r["doc_id"], r["score"]) for r in rows] == [(1, 0.5)]


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "cat sat cat"), (2, "cat")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    index_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("term", "doc_id", "tf").collect()}
    assert got == {tuple(r) for r in index.postings(index.terms_of(docs)).select("term", "doc_id", "tf").collect()}
