"""The queries of this package's operators over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import dual_tree, interpolation, jaccard_join, language_id, license_scan, packing, phrase_index, pii, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.top_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return interpolation.score(_table(spark, sf_dir, "documents"), F.coalesce(fold != 1, F.lit(True)))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


OP2 = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_WORDS = """list_filter(regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""

OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS t
  FROM i, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(k) WHERE len(w) > 0),
l AS (SELECT DISTINCT n FROM g),
x AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS t
  FROM d, l, unnest(range(1, len(w) - n + 2)) AS u(k) WHERE len(w) >= n),
h AS (SELECT doc_id, k, n, item_id FROM x JOIN g USING (n, t)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
y AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN y USING (doc_id)
"""

OP6 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, min(page_id) AS first FROM p WHERE octet_length(b) >= 100 GROUP BY d)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d
"""


OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(k) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE x <> y AND 100 * k >= {jaccard_join.PERCENT} * (p.n + q.n - k)),
r(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT y, root FROM r JOIN e ON x = node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node) USING (doc_id)
"""

_TEMPLATES = ", ".join(f"('{label}', {sorted(set(license_scan._words(text)))})" for label, text in license_scan.TEMPLATES)
_PHRASES = ", ".join(f"('{label}', {phrase.split()})" for phrase, label in license_scan.PHRASES)

OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
t(label, words) AS (VALUES {_TEMPLATES}),
p(label, words) AS (VALUES {_PHRASES}),
b AS (
  SELECT doc_id, label, k FROM d, p, unnest(range(0, len(w) - len(words) + 1)) AS u(k)
  WHERE w[k + 1 : k + len(words)] = words),
ln AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d),
li AS (SELECT doc_id, ls, i, len(ls[i]) <= {license_scan.WRAP} AS s0, coalesce(len(ls[i + 1]) <= {license_scan.WRAP}, false) AS s1, coalesce(len(ls[i + 2]) <= {license_scan.WRAP}, false) AS s2, coalesce(len(ls[i + 3]) <= {license_scan.WRAP}, false) AS s3 FROM ln, unnest(range(1, len(ls) + 1)) AS u(i)),
bl AS (SELECT doc_id, array_to_string(ls[i : i + CASE WHEN s0 AND s1 AND s2 AND s3 THEN 3 WHEN s0 AND s1 AND s2 THEN 2 WHEN s0 AND s1 THEN 1 ELSE 0 END], chr(10)) AS block FROM li),
l AS (SELECT doc_id, list_distinct({_WORDS.format("block")}) AS x FROM bl),
m AS (
  SELECT doc_id, label, len(list_intersect(x, words)) / len(words) AS c FROM l, t
  WHERE len(list_intersect(x, words)) >= ceil({license_scan.THRESHOLD} * len(words) - 1e-9)),
n AS (SELECT doc_id, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, max(c) AS best FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base IS NOT NULL THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_top_k": OP2, "op5_decontamination": OP5, "op6_warc": OP6, "op8_jaccard_join": OP8, "op9_license_scan": OP9}
