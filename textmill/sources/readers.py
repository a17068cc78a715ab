"""Sources: SGML articles, categories, judged collections, opinion sets, word vectors, stored indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Markup entities and their characters; the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#3;", ""), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    for name, by in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(by))
    return text


def _element(block: Column, tag: str) -> Column:
    """The text of a block's first such element, empty if there is none."""
    return F.coalesce(F.regexp_extract(block, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1), F.lit(""))


def articles(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """SGML files to (file, position, newid, title, body, text, tags); one row per REUTERS-style element with NEWID.

    path may be a folder, a glob or one file. Files are decoded whole, then cut into elements. Of elements
    that repeat an id the last in (file, position) order stays.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", encoding).alias("content"))
    blocks = files.select("file", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?is)<REUTERS\b.*?</REUTERS>"), F.lit(0))).alias("position", "block"))
    newid = F.regexp_extract("block", r'(?i)\bNEWID\s*=\s*"(\d+)"', 1)
    rows = blocks.where(newid != "").select(
        "file", "position", newid.cast("long").alias("newid"), unescaped(_element(F.col("block"), "TITLE")).alias("title"), unescaped(_element(F.col("block"), "BODY")).alias("body"),
        F.array_distinct(F.transform(F.regexp_extract_all("block", F.lit(r"(?is)<D>(.*?)</D>"), F.lit(1)), unescaped)).alias("tags"),
    )
    last = rows.groupBy("newid").agg(F.max_by(F.struct("file", "position", "title", "body", "tags"), F.struct("file", "position")).alias("r"))
    return last.select("r.file", "r.position", "newid", "r.title", "r.body", F.concat("r.title", F.lit("\n"), "r.body").alias("text"), "r.tags")


def article_categories(rows: DataFrame) -> DataFrame:
    """(category, doc_id) of all tags of all kinds."""
    return rows.select(F.explode("tags").alias("category"), F.col("newid").alias("doc_id")).distinct()


def category_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'Description (CODE) ...' to (category, description); code lower-cased; the last line of a code wins.

    Lines that start with * or @, and codes with white space, are left out.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    code = F.regexp_extract("line", r"\((.*?)\)", 1)
    rows = lines.where(~F.col("line").rlike(r"^[*@]") & F.col("line").contains("(")).select("n", code.alias("code"), F.trim(F.regexp_extract("line", r"^([^(]*)\(", 1)).alias("description"))
    return rows.where(F.col("code").rlike(r"^\s*\S+\s*$")).groupBy(F.lower(F.trim("code")).alias("category")).agg(F.max_by("description", "n").alias("description"))


def judged_collection(spark: SparkSession, documents: str, queries: str, judgements: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three JSON arrays to docs(doc_id, text), queries(query_id, text), qrels(query_id, doc_id, grade)."""
    read = spark.read.option("multiLine", True)
    docs = read.schema("id int, body string").json(documents).select(F.col("id").cast("long").alias("doc_id"), F.col("body").alias("text"))
    asked = read.schema("`query number` int, query string").json(queries).select(F.col("query number").cast("long").alias("query_id"), F.col("query").alias("text"))
    rels = read.schema("query_num string, id string, position int").json(judgements)
    return docs, asked, rels.select(F.col("query_num").cast("long").alias("query_id"), F.col("id").cast("long").alias("doc_id"), F.col("position").alias("grade"))


def opinions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """topics/* and summaries-gold/<topic>/* to articles(topic, text) and golds(topic, n, text), joined by name, not by listing order."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.txt)?(\.data)?$", 1)
    texts = spark.read.text(f"{path}/topics/*", wholetext=True).select(name.alias("topic"), F.col("value").alias("text"))
    file = F.input_file_name()
    golds = spark.read.text(f"{path}/summaries-gold/*/*", wholetext=True).select(F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("topic"), F.regexp_extract(file, r"(\d+)\.[^/.]*$", 1).try_cast("int").alias("n"), F.col("value").alias("text"))
    return texts, golds


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'word x x ...' to (word, vec)."""
    parts = F.split("value", " ")
    return spark.read.text(path).select(parts[0].alias("word"), F.slice(parts, 2, F.size(parts)).cast("array<float>").alias("vec"))


def index_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'term doc tf doc tf ...' to postings(term, doc_id, tf)."""
    pairs = F.regexp_extract_all("value", F.lit(r" ([^ ]+ [^ ]+)"), F.lit(1))
    # The line is cut before its pairs become rows, so no row carries it.
    lines = spark.read.text(path).select(F.substring_index("value", " ", 1).alias("term"), pairs.alias("pairs"))
    rows = lines.select("term", F.explode("pairs").alias("pair"))
    return rows.select("term", F.substring_index("pair", " ", 1).cast("long").alias("doc_id"), F.substring_index("pair", " ", -1).cast("long").alias("tf"))


def stored_index(spark: SparkSession, path: str):
    """The tables that writers.index wrote."""
    from textmill.operators.scoring import Index

    return Index(*(spark.read.parquet(f"{path}/{name}") for name in Index._fields))
