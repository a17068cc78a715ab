"""Index builders: postings, term statistics, tiers, k-gram, soundex and n-gram indexes, collocations.

Tables: docs(doc_id, text), tokens(doc_id, pos, token), postings(term, doc_id, tf), terms(term, cf, df),
doc_len(doc_id, dl), vocab(word, freq).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.functions.porter import stemmed_words
from textmill.shared import stored


def tokens(docs: DataFrame, analyzer: Callable[..., Column] = T.tokens) -> DataFrame:
    """All tokens with their places."""
    return docs.select("doc_id", F.posexplode(analyzer("text")).alias("pos", "token"))


def terms_of(docs: DataFrame, stop: Iterable[str] = T.STOP_WORDS, analyzer: Callable[..., Column] = T.tokens, stemmed: bool = False) -> DataFrame:
    """Kept tokens as terms (doc_id, pos, term); stemmed: the words' stems, made beside the words without a shuffle."""
    if not stemmed:
        return tokens(docs, analyzer).where(T.is_kept("token", stop)).withColumnRenamed("token", "term")
    words = docs.select("doc_id", analyzer("text").alias("token")).where("token is not null")
    both = words.select("doc_id", F.posexplode(F.arrays_zip("token", stemmed_words(F.col("token")).alias("stem"))).alias("pos", "t"))
    return both.where(T.is_kept("t.token", stop)).select("doc_id", "pos", F.col("t.stem").alias("term"))


def postings(terms: DataFrame) -> DataFrame:
    """Term frequency per term and document."""
    return terms.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def doc_postings(docs: DataFrame, stop: Iterable[str] = T.STOP_WORDS, analyzer: Callable[..., Column] = T.tokens, stemmed: bool = False) -> DataFrame:
    """The postings of docs(doc_id, text), counted within each document, without a shuffle; documents that share an id are counted together.

    A document's terms are sorted and joined by blanks; a run of one term is a match, whose length gives the frequency.
    """
    words = docs.select("doc_id", analyzer("text").alias("token"))
    if stemmed:
        pairs = F.arrays_zip("token", stemmed_words(F.col("token")).alias("stem"))
        kept = F.transform(F.filter(pairs, lambda t: T.is_kept(t["token"], stop)), lambda t: t["stem"])
        words = words.where("token is not null")
    else:
        kept = kept_terms(F.col("token"), stop, analyzer)
    runs = F.regexp_extract_all(F.array_join(F.sort_array(kept), " "), F.lit(r"([^ ]+)(?: \1(?![^ ]))*+"), F.lit(0))
    rows = words.select("doc_id", F.explode(runs).alias("run")).select(F.substring_index("run", " ", 1).alias("term"), "doc_id", "run")
    posts = rows.select("term", "doc_id", F.expr("(octet_length(run) + 1) div (octet_length(term) + 1)").alias("tf"))
    return posts if has_distinct_ids(docs) else posts.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))


def kept_terms(words: Column, stop: Iterable[str] = T.STOP_WORDS, analyzer: Callable[..., Column] = T.tokens) -> Column:
    """An array of tokens without those that aren't kept; the simple profile's are letters as they are."""
    return F.filter(words, (lambda w: ~w.isin(*stop)) if analyzer is T.tokens else (lambda w: T.is_kept(w, stop)))


def has_distinct_ids(docs: DataFrame) -> bool:
    return docs.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def term_stats(posts: DataFrame) -> DataFrame:
    """Collection and document frequency per term."""
    return posts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def doc_lengths(docs: DataFrame, posts: DataFrame) -> DataFrame:
    """Kept tokens per document, from the postings; documents without any have length 0."""
    counts = posts.groupBy("doc_id").agg(F.sum("tf").alias("n"))
    return docs.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("dl"))


def own_lengths(docs: DataFrame, stop: Iterable[str] = T.STOP_WORDS, analyzer: Callable[..., Column] = T.tokens, stemmed: bool = False) -> DataFrame:
    """doc_lengths of docs with distinct ids, from each document alone; a stem counts as its word."""
    return docs.select("doc_id", F.coalesce(F.size(kept_terms(analyzer("text"), stop, analyzer)), F.lit(0)).cast("long").alias("dl"))


def idf(terms: DataFrame, n_docs: int | Column, natural: bool = False) -> DataFrame:
    """log10(N / df), or the natural logarithm."""
    ratio = (F.lit(n_docs) if isinstance(n_docs, int) else n_docs) / F.col("df")
    return terms.withColumn("idf", F.log(ratio) if natural else F.log10(ratio))


def corpus_stats(doc_len: DataFrame) -> DataFrame:
    """One row: n_docs, avg_dl, total_dl."""
    return doc_len.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"), F.sum("dl").alias("total_dl"))


def limited(docs: DataFrame, n: int, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The first n documents in a stated order; 0 is none."""
    return docs.orderBy(*order).limit(n)


def index_lines(posts: DataFrame, block: int | None = None) -> DataFrame:
    """(term, line): term doc tf doc tf ...; the text form of the blocked index.

    With block, (term, block, line): a line holds the postings of so many ids, so no row grows with a frequent term.
    """
    pairs = F.sort_array(F.collect_list(F.struct("doc_id", "tf")))
    flat = F.array_join(F.transform(pairs, lambda p: F.concat_ws(" ", p["doc_id"].cast("string"), p["tf"].cast("string"))), " ")
    if block is None:
        return posts.groupBy("term").agg(F.concat_ws(" ", F.first("term"), flat).alias("line"))
    return posts.withColumn("block", F.floor(F.col("doc_id") / block)).groupBy("term", "block").agg(F.concat_ws(" ", F.first("term"), flat).alias("line"))


def tiered(posts: DataFrame, threshold: int) -> DataFrame:
    """Postings with tier high (tf >= threshold) or low."""
    return posts.withColumn("tier", F.when(F.col("tf") >= threshold, "high").otherwise("low"))


def vocabulary(docs: DataFrame, letters_only: bool = False, analyzer: Callable[..., Column] = T.tokens) -> DataFrame:
    """Words with their frequencies, unfiltered unless letters_only."""
    words = tokens(docs, analyzer).withColumnRenamed("token", "word")
    if letters_only:
        words = words.where(F.col("word").rlike(r"^\p{L}+$"))
    return words.groupBy("word").agg(F.count("*").alias("freq"))


def kgram_index(vocab: DataFrame, k: int, short: bool = False) -> DataFrame:
    """Rows (gram, word), a word once per occurrence of the gram in it."""
    return vocab.select(F.explode(T.kgrams(F.col("word"), k, short)).alias("gram"), "word")


def soundex_index(vocab: DataFrame) -> DataFrame:
    """Rows (code, word) of the words that have a code."""
    return vocab.select(T.soundex("word").alias("code"), "word").where("code is not null")


def token_lists(docs: DataFrame, stop: Iterable[str] | None = None, analyzer: Callable[..., Column] = T.tokens) -> DataFrame:
    """Rows (doc_id, words): the token sequence as an array."""
    words = analyzer("text")
    return docs.select("doc_id", (F.filter(words, lambda w: T.is_kept(w, stop)) if stop is not None else words).alias("words"))


def collocations(lists: DataFrame, min_count: int, min_pmi: float, n: int) -> DataFrame:
    """n-grams (2 or 3, else none) with count >= min_count and pointwise mutual information >= min_pmi.

    PMI of two: log2(c12 N) - log2(c1 c2); of three: log2(c123 N N) - log2(c1 c2 c3); N tokens in all.
    """
    spark = lists.sparkSession
    if n not in (2, 3):
        return spark.createDataFrame([], "gram string, n int, count long, pmi double")
    grams = lists.select(F.explode(T.ngrams(F.col("words"), n)).alias("gram")).groupBy("gram").agg(F.count("*").alias("count")).where(F.col("count") >= min_count)
    single = stored(lists.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("c")), "words")
    total = single.agg(F.sum("c").alias("total"))
    single = single.where(F.col("c") >= min_count)  # a word is as frequent as its grams
    out = grams.withColumn("parts", F.split("gram", " "))
    product = F.lit(1.0)
    for i in range(n):
        out = out.join(single.select(F.col("w").alias(f"w{i}"), F.col("c").alias(f"c{i}")), F.col("parts")[i] == F.col(f"w{i}"))
        product = product * F.col(f"c{i}")
    pmi = F.log2(F.col("count").cast("double") * F.pow(F.col("total").cast("double"), F.lit(float(n - 1)))) - F.log2(product)
    return out.crossJoin(total).select("gram", F.lit(n).alias("n"), "count", pmi.alias("pmi")).where(F.col("pmi") >= min_pmi)


def ngram_index(lists: DataFrame, grams: DataFrame) -> DataFrame:
    """Rows (gram, doc_id, occurrences) for the given grams (gram, n) of two or three words."""
    grams = stored(grams.select("gram", "n").distinct(), "grams")
    sizes = [r["n"] for r in grams.select("n").distinct().collect() if r["n"] in (2, 3)]
    if not sizes:
        return lists.sparkSession.createDataFrame([], f"gram string, doc_id {lists.schema['doc_id'].dataType.simpleString()}, occurrences long")
    found = lists.select("doc_id", F.explode(F.concat(*[T.ngrams(F.col("words"), n) for n in sorted(sizes)])).alias("gram"))
    return found.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram", "doc_id").agg(F.count("*").alias("occurrences"))


def ngram_stats(index: DataFrame) -> DataFrame:
    """Document frequency and occurrences per gram."""
    return index.groupBy("gram").agg(F.count("*").alias("df"), F.sum("occurrences").alias("occurrences"))


def category_docs(docs: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Distinct (kind, category, doc_id); all kinds share one namespace of categories."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("category")) for c in columns]))
    return docs.select("doc_id", rows.alias("r")).select("r.kind", "r.category", "doc_id").where("category is not null").distinct()
