"""Tolerant lookup: wildcards by k-gram intersection, and query repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import text as T


def wildcard_options(patterns: DataFrame, kgrams: DataFrame, k: int, verify: bool = True) -> DataFrame:
    """(pattern, word): words that have all of a pattern's grams and, with verify, match it."""
    grams = patterns.select("pattern").distinct().select("pattern", T.pattern_grams(F.col("pattern"), k).alias("grams"))
    wanted = grams.select("pattern", F.size("grams").alias("m"), F.explode("grams").alias("gram"))
    rows = kgrams.join(F.broadcast(wanted.select("gram").distinct()), "gram", "left_semi").distinct()
    if not verify:
        found = wanted.join(rows, "gram").groupBy("pattern", "m", "word").agg(F.count("*").alias("n")).where("n = m")
        return found.select("pattern", "word")
    # A word that matches has all grams, so those of the rarest one are enough to look at.
    sizes = rows.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(sizes, "gram").groupBy("pattern").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return rows.join(F.broadcast(rarest), "gram").where(F.rlike("word", T.as_regex(F.col("pattern")))).select("pattern", "word")


def sequential_options(patterns: DataFrame, kgrams: DataFrame, k: int) -> DataFrame:
    """(pattern, word) by the historical fold: grams that no word has are skipped, and an intersection that runs empty starts anew.

    The grams are folded in the pattern's order. A word's part in it is how far its grams go on from each place;
    the furthest of any word shows where an intersection runs empty, so no list of words is gathered.
    """
    grams = patterns.select("pattern").distinct().select("pattern", F.posexplode(F.filter(T.kgrams(F.col("pattern"), k), lambda g: (g != "$") & ~F.contains(g, F.lit("*")))).alias("pos", "gram"))
    there = grams.join(kgrams.select("gram").distinct(), "gram", "left_semi")
    order = Window.partitionBy("pattern").orderBy("pos")  # a pattern has few grams
    there = there.select("pattern", "gram", F.row_number().over(order).alias("i"))
    has = there.join(kgrams.distinct(), "gram").groupBy("pattern", "word").agg(F.array_sort(F.collect_list("i")).alias("own"))
    n = there.groupBy("pattern").agg(F.max("i").alias("n"))
    # From each place, the last one up to which the word has all grams; before the place if it lacks that one.
    places = F.sequence(F.lit(1), F.col("n"))
    ends = F.transform(places, lambda a: F.aggregate(places, a - 1, lambda end, x: F.when((x == end + 1) & F.array_contains("own", x), x).otherwise(end)))
    runs = has.join(n, "pattern").withColumn("ends", ends)
    best = runs.select("pattern", "n", F.posexplode("ends").alias("a", "end")).groupBy("pattern", "n", "a").agg(F.max("end").alias("end"))
    best = best.groupBy("pattern", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "end"))), lambda s: s["end"]).alias("best"))
    # The place where the last intersection starts: an intersection that ends at e is empty after e + 1, so the next starts at e + 2.
    start = F.aggregate(places, F.lit(1), lambda a, x: F.when((a <= F.col("n")) & (F.element_at("best", F.least(a, F.col("n"))) < F.col("n")), F.element_at("best", F.least(a, F.col("n"))) + 2).otherwise(a))
    starts = best.select("pattern", start.alias("a"))
    return runs.join(starts, "pattern").where((F.col("a") <= F.col("n")) & (F.element_at("ends", F.least("a", "n")) == F.col("n"))).select("pattern", "word")


def repaired(words: DataFrame, vocab: DataFrame, kgrams: DataFrame, k: int) -> DataFrame:
    """words(query_id, pos, word) with a column repaired.

    Words of the vocabulary stay; others, patterns or misspelt, become their option with the highest
    frequency, then the first in order; words without an option stay.
    """
    known = words.join(vocab.select("word"), "word", "left_semi").select("word").distinct().withColumn("known", F.lit(True))
    unknown = words.join(known, "word", "left").where("known is null").select(F.col("word").alias("pattern")).distinct()
    options = wildcard_options(unknown, kgrams, k).join(vocab, "word")
    best = Window.partitionBy("pattern").orderBy(F.desc("freq"), "word")
    chosen = options.withColumn("n", F.row_number().over(best)).where("n = 1").select(F.col("pattern").alias("word"), F.col("word").alias("option"))
    return words.join(chosen, "word", "left").select("query_id", "pos", "word", F.coalesce("option", "word").alias("repaired"))
