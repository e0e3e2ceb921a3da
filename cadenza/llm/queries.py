"""Registered queries: each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, exact_dedup, line_dedup, lm_scoring, mixing, ngram_join, packing, periodic_runs, sharding, suffix_family, toxicity, url_filter, vector_codes
from cadenza.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 8) AS BIGINT) AS h
  FROM documents),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM rows GROUP BY source),
caps AS (
  SELECT *, 3 * s AS cap, CAST(sum(s) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS weights,
         CAST(coalesce(sum(3 * s) OVER up, 0) AS BIGINT) AS cap_before, CAST(coalesce(sum(w) OVER up, 0) AS BIGINT) AS w_before
  FROM by_source
  WINDOW up AS (ORDER BY 3.0 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stops AS (
  SELECT *, CAST(total - cap_before AS HUGEINT) * w > CAST(cap AS HUGEINT) * (weights - w_before) AS stop FROM caps),
shares AS (
  SELECT source, s, stop, cap, w,
         total - coalesce(sum(cap) FILTER (WHERE stop) OVER (), 0) AS num,
         weights - coalesce(sum(w) FILTER (WHERE stop) OVER (), 0) AS den
  FROM stops),
targets AS (
  SELECT source, s, CASE WHEN stop THEN CAST(cap AS DOUBLE) ELSE CAST(w * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target
  FROM shares),
budgets AS (
  SELECT source, s, target, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS whole FROM targets),
cells AS (
  SELECT source, h, CAST(sum(size) AS BIGINT) AS c FROM rows GROUP BY source, h),
cum AS (
  SELECT source, h, c, CAST(sum(c) OVER (PARTITION BY source ORDER BY h) AS BIGINT) AS upto FROM cells),
cut AS (
  SELECT m.source, m.h, b.target, b.s, b.whole,
         CASE WHEN m.upto <= b.target - b.whole * b.s THEN 1
              WHEN m.upto - m.c <= b.target - b.whole * b.s
                   AND m.upto - (b.target - b.whole * b.s) < (b.target - b.whole * b.s) - (m.upto - m.c) THEN 1
              ELSE 0 END AS extra
  FROM cum m JOIN budgets b ON m.source IS NOT DISTINCT FROM b.source)
SELECT r.doc_id, r.size, c.s AS source_size, c.target, CAST(r.size * (c.whole + c.extra) AS BIGINT) AS taken
FROM rows r JOIN cut c ON r.source IS NOT DISTINCT FROM c.source AND r.h = c.h
"""

EXACT_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
"""

URL_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
f AS (
  SELECT *, (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') AS r1,
         (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') AS r2,
         (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') AS r3,
         (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') AS r4
  FROM p)
SELECT page_id, host, path,
       CASE WHEN r2 THEN 'example.net/en/' WHEN r3 THEN 'example.com/de/' WHEN r4 THEN 'org/fr/' WHEN r1 THEN 'net/' END AS rule,
       CASE WHEN r2 THEN 'allow' WHEN r3 THEN 'block' WHEN r4 THEN 'allow' WHEN r1 THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""

URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def query(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(read(spark, sf_dir, "documents"))


@query("op2_exact_dedup", EXACT_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents")).drop("n_chunks")


@query("op3_ngram_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shard_rows(docs, ["doc_id", "text_crc32"]).withColumns(
        {"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


@query("op5_lm_scoring")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(read(spark, sf_dir, "documents"))


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


@query("op7_mixing", MIX_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.stage(mixing.sized(read(spark, sf_dir, "documents")))
    return mixing.mix(rows, mixing.mix_plan(rows)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op8_decontaminate")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash")


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op10_url_filter", URL_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def _code_round(k: int) -> str:
    """CTEs of one assignment of all parts to codebook k and of codebook k + 1."""
    return f"""
near{k} AS (
  SELECT row_no, part, idx, dist FROM (
    SELECT x.row_no, x.part, c.idx, sum((x.v - c.v) * (x.v - c.v)) AS dist,
           row_number() OVER (PARTITION BY x.row_no, x.part ORDER BY sum((x.v - c.v) * (x.v - c.v)), c.idx) AS rn
    FROM comp x JOIN book{k} c ON x.part = c.part AND x.pos = c.pos GROUP BY x.row_no, x.part, c.idx) WHERE rn = 1),
mean{k} AS (
  SELECT n.part, n.idx, x.pos, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS n
  FROM near{k} n JOIN comp x ON n.row_no = x.row_no AND n.part = x.part GROUP BY ALL),
book{k + 1} AS (
  SELECT b.part, b.idx, b.pos,
         CASE WHEN m.n IS NULL THEN b.v ELSE (m.s - (((m.s % m.n) + m.n) % m.n)) // m.n END AS v
  FROM book{k} b LEFT JOIN mean{k} m ON b.part = m.part AND b.idx = m.idx AND b.pos = m.pos)"""


CODES_SQL = f"""
WITH kept AS (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row_no FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comp AS (
  SELECT row_no, (i - 1) // (n // 16) AS part, (i - 1) % (n // 16) AS pos,
         CAST(floor(CAST(embedding[i] AS DOUBLE) * 256) AS BIGINT) AS v
  FROM (SELECT row_no, embedding, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
book0 AS (SELECT part, row_no AS idx, pos, v FROM comp WHERE row_no < 64),
{_code_round(0)},
{_code_round(1)},
{_code_round(2)},
codes AS (
  SELECT row_no, string_agg(printf('%02x', CAST(idx AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error
  FROM near2 GROUP BY row_no),
by_label AS (
  SELECT k.label, CAST(sum(c.error) AS BIGINT) AS label_error FROM kept k JOIN codes c USING (row_no) GROUP BY k.label),
digest AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, idx, pos)) AS codebooks_sha256 FROM book2)
SELECT k.vec_id, k.label, c.code, c.error, l.label_error, d.codebooks_sha256
FROM kept k JOIN codes c USING (row_no) JOIN by_label l ON k.label IS NOT DISTINCT FROM l.label CROSS JOIN digest d
"""


@query("op11_vector_codes", CODES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_vectors(read(spark, sf_dir, "embeddings"))


@query("op12_suffix_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_family.remove_repeats(read(spark, sf_dir, "documents")).drop("starts", "ends")


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(read(spark, sf_dir, "documents"), tail=periodic_runs.repeated_tail).drop(
        "starts", "lengths", "periods")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
