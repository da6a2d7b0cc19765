"""The subpackage's queries for the driver, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_extract, line_dedup, ngram_join, packing, pii, token_counts, topk, toxicity, url_filters
from .common import materialize, table

#: The contract's rules (fixed values).
URL_RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)


def vocabulary() -> str:
    """The vocabulary file of the queries; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1
    score = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), ~held_out("id"))
    scored = docs.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filters.host_path_rule(*rule) for rule in URL_RULES]
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), [*rules, *url_filters.GENERAL_RULES])


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = token_counts.length_histogram(table(spark, sf_dir, "documents"), vocabulary())
    return token_counts.context_limits(materialize(histogram, "lengths"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces_of(table(spark, sf_dir, "documents"), vocabulary()))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(f"pii_base_{k.name}").cast("bigint").alias(f"n_{k.name}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("all").alias("spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontam.with_marks(docs, table(spark, sf_dir, "benchmark"), "marks")
    return marked.select(
        "doc_id",
        F.col("marks.n_words").alias("n_words"),
        decontam.hit_words("marks").alias("n_hit"),
        F.size("marks.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("marks.items", ","), 256).alias("items_sha256"),
        decontam.contaminated("marks").alias("contaminated"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_url_filters, op3_topk, op4_token_counts, op5_packing, op6_ngram_join, op7_pii, op8_line_dedup, op9_html_extraction, op10_decontamination)}


#: A-Z lower-cased in DuckDB, as everywhere here.
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP2 = rf"""
WITH parts AS (
  SELECT page_id, instr(url, '://') AS sep, url FROM pages
), found AS (
  SELECT page_id,
    CASE WHEN sep > 0 THEN translate(regexp_extract(substr(url, sep + 3), '^[^/?#]*'), {_AZ}) ELSE '' END AS host,
    CASE WHEN sep > 0 THEN regexp_extract(substr(url, sep + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM parts
), rules(rule, host, path, verdict) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'block'),
  ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
), general(pattern, expression) AS (
  SELECT w, '^([^/]*[.-])?' || w || '[.-][^/]*$' FROM (VALUES ('spam'), ('pills'), ('casino'), ('porn'), ('xxx'), ('viagra'), ('malware'), ('phishing')) AS words(w)
), judged AS (
  SELECT f.page_id, f.host, f.path,
    (SELECT max_by(r.rule, length(r.rule)) FROM rules r WHERE (f.host = r.host OR f.host LIKE '%.' || r.host) AND starts_with(f.path, r.path)) AS rule,
    (SELECT max_by(g.pattern, length(g.pattern)) FROM general g WHERE regexp_matches(f.host, g.expression)) AS pattern
  FROM found f
)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(r.verdict, CASE WHEN j.pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  CASE WHEN j.rule IS NULL THEN j.pattern END AS pattern
FROM judged j LEFT JOIN rules r ON j.rule = r.rule
"""

_OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""

_OP6 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS s FROM w
), e AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT u, v FROM shared WHERE 100 * k >= 90 * (n + m - k)
), both_ways AS MATERIALIZED (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.v FROM reach r JOIN both_ways b ON r.seen = b.u
), top AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, t.component_id FROM s JOIN top t ON s.doc_id = t.doc_id
"""

_OP8 = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) AS key FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.doc_id, k.pos, k.line, r.first IS NOT NULL AND r.first <> k.doc_id AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_OP10 = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM iw, LATERAL (SELECT unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows
), spots AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM dw, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)
), hits AS (
  SELECT s.doc_id, s.i, s.n, x.item_id FROM spots s JOIN windows x ON s.n = x.n AND s.win = x.win
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items t ON d.doc_id = t.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": _OP2, "op3_topk": _OP3, "op6_ngram_join": _OP6, "op8_line_dedup": _OP8, "op10_decontamination": _OP10}
