"""Registered queries of this package and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, cube, gam, hnsw, lines, negatives, outliers, phrases, preference, shards, simhash, topk, urlrules
from .common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(
        table(spark, folder, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, distance=2)
    return found.selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) AS fingerprint", "component_id")


def op7_cube(spark: SparkSession, folder: str) -> DataFrame:
    return cube.mixed(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


#: Host, path and verdict of the url rules.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]


def op9_urls(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judged(table(spark, folder, "pages"), rules)


OP9_SQL = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {rules}),
cut AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
hosts AS (SELECT page_id, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, row_number() OVER () AS n FROM cut),
fit AS (SELECT h.*, r_host || r_path AS rule, r_verdict,
  row_number() OVER (PARTITION BY n ORDER BY length(r_host || r_path) DESC NULLS LAST) AS place
  FROM hosts h LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM fit WHERE place = 1
""".format(rules=", ".join(str(r) for r in URL_RULES))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return gam.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_preference(spark: SparkSession, folder: str) -> DataFrame:
    return preference.preferences(preference.earlier_answer_pairs(table(spark, folder, "conversations")))


def op10_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.judged(table(spark, folder, "documents"))


#: A single repeated line of at least so many words goes.
LINE_WORDS = 8


def op4_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.deduplicated(table(spark, folder, "documents"), run=3, words=LINE_WORDS).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.deduplicated(table(spark, folder, "documents"), window=35).drop("kept")


def op6_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, folder, "embeddings"), least=0.93)


#: Tokenizers that are aligned.
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def op12_align(spark: SparkSession, folder: str) -> DataFrame:
    found = align.align_documents(
        table(spark, folder, "documents"), *map(public_tokenizers.path, ALIGNED), public_tokenizers.PATTERN, hashed=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").select(
        "vec_id", shards.integers(F.col("embedding")).alias("vector"), label.alias("label"),
        (F.col("vec_id") % 100 == 0).alias("is_anchor"))
    return negatives.hard_negatives(rows, positives=5, negatives=10, low=30, high=90).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(
        "vec_id", shards.integers(F.col("embedding")).alias("vector"), (F.col("vec_id") % 50 == 0).alias("is_query"))
    return topk.top_k(rows, k=5)


WHOLE_VECTORS = """
cut AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)"""

OP13_SQL = f"""
WITH {WHOLE_VECTORS},
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM cut q JOIN cut c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP11_SQL = f"""
WITH {WHOLE_VECTORS},
scored AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM cut a JOIN cut c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
  WHERE a.label IS NOT NULL AND c.label IS NOT NULL),
near AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same),
fits AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score,
  n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
  FROM near p JOIN scored n ON p.anchor_id = n.anchor_id AND p.place <= 5 AND NOT n.same
  AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM fits WHERE rank <= 10
"""


QUERIES = {"op1_bpe": op1_bpe, "op2_simhash": op2_simhash, "op3_quality": op3_quality, "op4_lines": op4_lines,
           "op5_phrases": op5_phrases, "op6_embeddings": op6_embeddings, "op7_cube": op7_cube, "op8_preference": op8_preference,
           "op10_outliers": op10_outliers, "op9_urls": op9_urls, "op11_negatives": op11_negatives, "op12_align": op12_align, "op13_topk": op13_topk}
SQL: dict[str, str] = {"op9_urls": OP9_SQL, "op11_negatives": OP11_SQL, "op13_topk": OP13_SQL}
