"""The pipeline operators' registered queries (each over its whole table) and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplanes, byte_cnn, decontaminate, mixing, notices, parity_join, segment_topk, url_reputation, warc_bundle, weak_labels

#: Rules of op3: (verdict, host/path).
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
URL_THRESHOLD = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.round("mix_prob", 9).alias("prob"), F.col("mix_sampled").alias("sampled"))


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    known = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.when(known, bad).alias("bad"))
    return url_reputation.judge_urls(_table(spark, sf_dir, "pages"), outcomes, URL_RULES, URL_THRESHOLD)


def op4_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = bitplanes.write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return bitplanes.read_token_files(manifest)


def op5_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify_quality(_table(spark, sf_dir, "documents"))


def op6_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=85, count_links=True)


def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = byte_cnn.fit(docs, ~held_out)
    return byte_cnn.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundle.read_bundles(warc_bundle.write_bundles(_table(spark, sf_dir, "pages")))


def op10_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_topk.exact_topk(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _op3_sql(z: float = 1.645, least: float = url_reputation.LEAST_RHO, most: float = url_reputation.MOST_RHO) -> str:
    listed = ", ".join(f"('{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{r}', '{v}')" for v, r in URL_RULES)

    def rho(level: str, p: str) -> str:
        return f"greatest({least}, least({most}, coalesce((SELECT CASE WHEN sum(n * (n - 1) * {p} * (1 - {p})) <> 0 THEN sum((bad - n * {p}) * (bad - n * {p}) - n * {p} * (1 - {p})) / sum(n * (n - 1) * {p} * (1 - {p})) END FROM {level}), {most})))"

    return f"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), g AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{url_reputation.UPPER}', '{url_reputation.UPPER.lower()}') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), l AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1
), h AS (
  SELECT host, count(l.bad)::DOUBLE AS n, coalesce(sum(l.bad), 0)::DOUBLE AS bad,
         list_extract(string_split(host, '.'), -1) AS suffix,
         CASE WHEN len(string_split(host, '.')) < 2 THEN host ELSE list_extract(string_split(host, '.'), -2) || '.' || list_extract(string_split(host, '.'), -1) END AS domain
  FROM g LEFT JOIN l ON g.page_id = l.doc_id GROUP BY 1
), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, ((SELECT sum(bad) + 1 FROM h) - sum(bad)) / ((SELECT sum(n) + 2 FROM h) - sum(n)) AS p FROM h GROUP BY 1),
us AS (SELECT suffix, n AS up_n, bad AS up_bad, least(1 / {rho("s", "p")} - 1, (SELECT sum(n) + 2 FROM h) - n) AS up_w, p AS up_p FROM s),
d AS (SELECT domain, n, bad, (up_bad - bad + up_w * up_p) / (up_n - n + up_w) AS p, up_n - n + up_w AS held
      FROM (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2) JOIN us USING (suffix)),
ud AS (SELECT domain, n AS up_n, bad AS up_bad, least(1 / {rho("d", "p")} - 1, held) AS up_w, p AS up_p FROM d),
hh AS (SELECT host, n, bad, (up_bad - bad + up_w * up_p) / (up_n - n + up_w) AS p, up_n - n + up_w AS held FROM h JOIN ud USING (domain)),
hw AS (SELECT *, least(1 / {rho("hh", "p")} - 1, held) AS w FROM hh),
ab AS (SELECT host, bad + w * p AS a, n - bad + w * (1 - p) AS b FROM hw),
v AS (SELECT host, a / (a + b) AS mean, greatest(a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0) AS lower_bound FROM ab),
rules(rule_host, rule_path, rule, verdict) AS (VALUES {listed}),
best AS (
  SELECT host, path, arg_min(struct_pack(rule := rule, verdict := verdict), struct_pack(o := -length(rule), rule := rule)) AS hit
  FROM (SELECT DISTINCT host, path FROM g) x JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1, 2
)
SELECT g.page_id, g.host, g.path, best.hit.rule AS rule, coalesce(best.hit.verdict, CASE WHEN lower_bound > {URL_THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
       round(mean, 6) AS bad_rate, round(lower_bound, 6) AS bad_rate_lower
FROM g JOIN v USING (host) LEFT JOIN best ON g.host = best.host AND g.path = best.path
"""


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h FROM p),
f AS (SELECT h, min(page_id) AS first_id, count(*) AS n FROM d GROUP BY 1),
j AS (SELECT d.*, CASE WHEN n > 1 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM d JOIN f USING (h))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM j
"""


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


QUERIES = {
    "op1_latent_decontamination": op1_latent_decontamination,
    "op2_raked_mix": op2_raked_mix,
    "op3_host_reputation": op3_host_reputation,
    "op4_bit_planes": op4_bit_planes,
    "op5_weak_labels": op5_weak_labels,
    "op6_license_notices": op6_license_notices,
    "op7_parity_join": op7_parity_join,
    "op8_byte_cnn": op8_byte_cnn,
    "op9_seekable_warc": op9_seekable_warc,
    "op10_segment_topk": op10_segment_topk,
}
SQL = {"op2_raked_mix": mixing.mix_sql(), "op3_host_reputation": _op3_sql(), "op9_seekable_warc": OP9_SQL, "op10_segment_topk": OP10_SQL}
