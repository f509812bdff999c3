"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .collocations import collocations, oracle_sql as collocation_sql
from .decontamination import decontaminate, oracle_sql as decontamination_sql
from .hard_negatives import hard_negatives
from .language import identify_language, in_fold, train_language_model
from .license_scan import oracle_sql as license_sql, scan_licenses
from .lm_scoring import score_texts
from .mixing import mix_sources
from .near_duplicates import near_duplicates
from .packing import pack_windows
from .quality import quality_rules, train_perplexity
from .sharding import shard_by_bytes
from .topk import exact_top_k
from .url_filter import Rule, filter_urls, oracle_sql as url_filter_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(_table(spark, sf_dir, "documents"), shards=24)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", in_fold(F.col("doc_id"), 5, 0))
    model = train_language_model(documents.filter(~F.col("held_out")))
    return identify_language(documents.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=5, percent=75)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_windows(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules(documents, train_perplexity(documents), carried=["doc_id"])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = in_fold(F.col("doc_id"), 7, 2)
    return score_texts(_table(spark, sf_dir, "documents"), ~held_out, order=3).withColumn("held_out", held_out)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), positives=5, negatives=5, every=100, low_percent=80)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"), most_words=5, least=100, subsumed_percent=100, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_url_filter": op2_url_filter,
    "op3_sharding": op3_sharding,
    "op4_language_id": op4_language_id,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_packing": op6_packing,
    "op7_topk": op7_topk,
    "op8_quality_rules": op8_quality_rules,
    "op9_mixing": op9_mixing,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_decontamination": op11_decontamination,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": license_sql(),
    "op5_near_duplicates": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
    lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents
), e AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen
), m AS (
  SELECT node, min(seen) AS component_id FROM r GROUP BY node
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id
""",
    "op2_url_filter": url_filter_sql(URL_RULES),
    "op7_topk": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(max(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e) GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
""",
    "op11_decontamination": decontamination_sql(window=10),
    "op12_hard_negatives": """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.e AS anchor, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.e) = len(c.e)
), p AS (
  SELECT anchor_id, anchor, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id, anchor ORDER BY score DESC, vec_id) AS band FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id, anchor ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, anchor, band ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id,
       positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id, anchor) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, anchor, band ORDER BY score DESC, vec_id) <= 5
""",
    "op13_collocations": collocation_sql(),
    "op9_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, coalesce(CAST(doc_id AS VARCHAR), text, '') AS name FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1) AS weight,
         source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER earlier, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM w WINDOW earlier AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT arg_min(level, cap / weight) FROM l WHERE cap > level * weight) * weight), cap) AS target,
         CAST(('0x' || substr(md5('mix' || coalesce(source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY least(d.size // 16, 4095), substr(md5(d.name), 1, 2), d.size, d.doc_id) - 1 AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST((floor((k + 1) * rate + u) - floor(k * rate + u)) * size AS BIGINT) AS taken FROM r
""",
}
