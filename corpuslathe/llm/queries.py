"""The queries opN_<name> of this subpackage and their SQL.

Each reads its whole table, applies the operator of its module with its
production parameters and derives the result's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, embedding_dedup, hard_negatives, html, line_dedup, minhash, mixing, packing, quality, runs, secrets, sharding, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op4_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no repositories; a source's languages stand for those of an owner."""
    return secrets.digest(secrets.secret_spans(_table(spark, sf_dir, "documents"), repo_col=F.concat_ws("/", "source", "lang"), owner_col="source"))


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no URLs: its sources are the hosts, their languages the paths."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~toxicity.held_out()))
    return quality.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "evidence", "host_rate", "path_rate", "score", "keep")


def op8_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    kept = line_dedup.kept_texts(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_table(spark, sf_dir, "documents"), tails=True)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS h FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * pairs.n >= 75 * (x.n + y.n - pairs.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.r)
SELECT sizes.doc_id, sizes.n AS n_shingles, c.component_id, sizes.doc_id = c.component_id AS kept
FROM sizes JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""

_ASSIGN = secrets.ASSIGN.replace("'", "''")
_LIKE = r"""length({0}) >= 16 AND regexp_matches({0}, '[0-9]') AND regexp_matches({0}, '[A-Za-z]') AND len(list_distinct(string_split({0}, ''))) >= 9
  AND NOT regexp_matches({0}, '(?i)example|sample|changeme|placeholder|your|dummy|xxxx|1234567|abcdef01')
  AND len(list_filter(range(1, length({0}) - 4), lambda i: lower({0}[i:i + 5]) = repeat(lower({0}[i:i]), 6))) = 0"""
_STRING = "coalesce(string_agg(CASE k WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'bare' END || ':' || s || ':' || e, ',' ORDER BY s, k)%s, '')"
OP5_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT r, source, repo, 0 AS k, 6 AS least, regexp_extract_all(t, '{_ASSIGN}', 0) AS m, regexp_extract_all(t, '{_ASSIGN}', 2) AS v, string_split_regex(t, '{_ASSIGN}') AS g FROM d
  UNION ALL SELECT r, source, repo, 1, 20, regexp_extract_all(t, '{secrets.ACCESS}', 0) AS m, m, string_split_regex(t, '{secrets.ACCESS}') FROM d
  UNION ALL SELECT r, source, repo, 2, 24, regexp_extract_all(t, '[0-9a-f]{{24,}}', 0) AS m, m, string_split_regex(t, '[0-9a-f]{{24,}}') FROM d
  UNION ALL SELECT r, source, repo, 3, 16, regexp_extract_all(t, '{secrets.BARE}', 0) AS m, m, string_split_regex(t, '{secrets.BARE}') FROM d),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0),
spans AS (
  SELECT r, source, repo, k, CASE WHEN k = 3 THEN rtrim(v[i], '.') ELSE v[i] END AS whole, rtrim(v[i], '.') AS v, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s, CASE WHEN k = 3 THEN length(rtrim(v[i], '.')) ELSE length(m[i]) END AS n, least FROM each),
hits AS (SELECT r, source, repo, k, v, s, s + n AS e, {_LIKE.format("v")} AS random FROM spans WHERE length(whole) >= least),
base AS (SELECT * FROM hits WHERE k < 3),
counts AS (SELECT v, CASE WHEN count(DISTINCT source) >= 3 OR count(DISTINCT source) = 2 AND count(DISTINCT repo) >= 6 THEN 'widespread' WHEN any_value(random) THEN 'live' ELSE 'weak' END AS verdict FROM base GROUP BY v),
bare AS (SELECT * FROM hits h WHERE k = 3 AND random AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = h.r AND b.s < h.e AND h.s < b.e)),
told AS (SELECT a.*, verdict FROM (SELECT * FROM base UNION ALL SELECT * FROM bare) a LEFT JOIN counts USING (v) WHERE k < 3 OR verdict = 'live'),
rows_ AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {_STRING % " FILTER (k < 3)"} AS b, {_STRING % ""} AS spans,
    count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'widespread') AS n_widespread FROM told GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_widespread, 0) AS n_widespread
FROM d LEFT JOIN rows_ USING (r)
"""

_ENTROPY = "ln(list_sum(list_transform(p, lambda x: pow(x, {0})))) - {0} * list_sum(list_transform(p, lambda x: pow(x, {0}) * ln(x))) / list_sum(list_transform(p, lambda x: pow(x, {0})))"
_REPEATS = "pow(list_min(p), {0}) / list_sum(list_transform(p, lambda x: pow(x, {0}))) / list_min(p)"
OP6_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key, coalesce(ceil(strlen(text) / 4), 0)::BIGINT AS tokens, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS name FROM documents),
totals AS (SELECT key, sum(tokens)::BIGINT AS total FROM d GROUP BY 1 HAVING sum(tokens) > 0),
one AS (SELECT list(total / t ORDER BY key) AS p, any_value(t) AS t FROM totals, (SELECT sum(total)::DOUBLE AS t FROM totals)),
search AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS lo2, 1.0::DOUBLE AS hi2, p, t, h1 + {mixing.FLATTEN} * greatest(ln(len(p)) - h1, 0.0) + 1e-12 AS aim FROM (SELECT *, {_ENTROPY.format("1.0")} AS h1 FROM one)
  UNION ALL
  SELECT i + 1, CASE WHEN g THEN lo ELSE m END, CASE WHEN g THEN m ELSE hi END, CASE WHEN g2 THEN lo2 ELSE m2 END, CASE WHEN g2 THEN m2 ELSE hi2 END, p, t, aim
  FROM (SELECT *, {_ENTROPY.format("m")} <= aim AS g, {_REPEATS.format("m2")} <= {mixing.MOST_REPEATS} AS g2 FROM (SELECT *, (lo + hi) / 2 AS m, (lo2 + hi2) / 2 AS m2 FROM search WHERE i < {mixing.TURNS}))),
alpha AS (SELECT least(ceil(greatest(hi, hi2) * 1e9) / 1e9, 1.0) AS a, p, t FROM search WHERE i = {mixing.TURNS}),
plan AS (
  SELECT *, floor(target / total + 1e-6)::INT AS whole FROM (
    SELECT key, total, pow(total / t, a) / list_sum(list_transform(p, lambda x: pow(x, a))) AS weight, weight * t AS target FROM totals, alpha)),
read AS (
  SELECT *, md5('1:' || epoch || ':' || name) AS ord FROM (
    SELECT *, unnest(range(0, 1 + CASE WHEN tokens > 0 THEN greatest(CASE WHEN target - whole * total >= 1 THEN whole ELSE whole - 1 END, 0) ELSE 0 END))::INT AS epoch FROM d JOIN plan USING (key))),
placed AS (SELECT *, epoch * total + sum(tokens) OVER (PARTITION BY key, epoch ORDER BY ord ROWS UNBOUNDED PRECEDING) AS upto FROM read),
kept AS (SELECT *, floor((upto - tokens) / greatest(weight * {mixing.BLOCK_TOKENS}, 1.0))::BIGINT AS block FROM placed WHERE epoch < whole OR tokens = 0 OR upto <= target)
SELECT doc_id, source, tokens, epoch, block, row_number() OVER (PARTITION BY block ORDER BY ord, epoch, key) - 1 AS position FROM kept
"""

OP9_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
fine AS MATERIALIZED (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM fine a JOIN fine b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach(r, t) AS (SELECT r, r FROM v UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.t),
c AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.t GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c USING (r) LEFT JOIN (SELECT a AS r, count(*) AS n FROM links GROUP BY 1) USING (r)
"""

OP11_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents),
lines AS MATERIALIZED (
  SELECT r, doc_id, i, t[i] AS line, translate(regexp_replace(t[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM d)),
common AS (
  SELECT k, max(doc_id) AS largest FROM lines WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 3),
judged AS (SELECT lines.*, common.k IS NOT NULL AND lines.doc_id IS DISTINCT FROM largest AS gone FROM lines LEFT JOIN common ON common.k = lines.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""

OP12_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS s
  FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, vec_id NULLS LAST, b) <= 5),
pairs AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.s AS positive_score, n.s AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.vec_id NULLS LAST, n.b)::INT AS rank
  FROM positives p JOIN scores n ON n.a = p.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM pairs WHERE rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_anisotropic_search": op4_anisotropic_search,
    "op5_secret_scan": op5_secret_scan,
    "op6_temperature_mixing": op6_temperature_mixing,
    "op7_quality": op7_quality,
    "op8_lpt_sharding": op8_lpt_sharding,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_line_dedup": op11_line_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op3_minhash_near_dedup": OP3_SQL,
    "op5_secret_scan": OP5_SQL,
    "op6_temperature_mixing": OP6_SQL,
    "op9_embedding_near_dedup": OP9_SQL,
    "op11_line_dedup": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
