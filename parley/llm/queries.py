"""The registered query of each operator, and the same in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import conversations, decontaminate, line_dedup, merkle, mixing, ngram_join, pii, pitman_yor, quality, quality_sql, sharding, suffix_dedup, token_files, tree_sql, urls

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return got.select("doc_id", *(F.col("quality_" + c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats_report(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_report(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.lm_scores(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_ngram_join, op3_sharding, op4_token_files, op5_url_filter, op6_line_dedup, op7_decontamination, op8_quality, op9_suffix_dedup, op10_mixing, op11_merkle_manifest, op12_conversation_repair, op13_lm_scores)}

_A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL: dict[str, str] = {
    "op8_quality": quality_sql.OP8,
    "op11_merkle_manifest": tree_sql.OP11,
    "op12_conversation_repair": tree_sql.OP12,
    "op3_sharding": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::UBIGINT AS h
  FROM documents
), b AS (
  SELECT r, doc_id, n_bytes, depth, lpad(bin(h >> (48 - depth)::UBIGINT), depth::INT, '0') AS shard
  FROM d, range({sharding.START_BITS}, 25) t(depth)
), s AS (
  SELECT *, sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_rows FROM b WINDOW w AS (PARTITION BY depth, shard)
)
SELECT doc_id, n_bytes, shard, depth::BIGINT AS depth, shard_bytes::BIGINT AS shard_bytes, shard_rows::BIGINT AS shard_rows
FROM s WHERE shard_bytes <= {sharding.LIMIT} OR shard_rows = 1
QUALIFY row_number() OVER (PARTITION BY r ORDER BY depth) = 1
""",
    "op5_url_filter": f"""
WITH r(action, host, path) AS (VALUES {", ".join(str(x) for x in urls.RULES)}), p AS (
  SELECT row_number() OVER () AS k, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_A_Z}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
)
SELECT page_id, q.host AS host, q.path AS path, r.host || r.path AS rule, coalesce(action, 'allow') AS verdict
FROM q LEFT JOIN r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path)
QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, action DESC) = 1
""",
    "op6_line_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_A_Z}) AS key FROM l),
o AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, coalesce(k.doc_id < o.keeper, false) AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
""",
    "op7_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_A_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
bk AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM bw),
ns AS (SELECT DISTINCT n FROM bk),
dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, ns WHERE len(w) >= n),
hits AS (SELECT r, i, bk.n AS n, item_id FROM (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM dw) x JOIN bk USING (n, k)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS items FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
""",
    "op10_mixing": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS src, md5(coalesce(doc_id::VARCHAR, '')) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT src, sum(size)::BIGINT AS source_size, [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 3.0::DOUBLE * sum(size)::DOUBLE AS cap
  FROM d GROUP BY src
), l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER f, 0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0::DOUBLE)) AS level
  FROM s WINDOW f AS (ORDER BY cap / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, least(cap, coalesce(max(CASE WHEN level * w <= cap THEN level END) OVER () * w, cap)) AS target FROM l
), q AS (
  SELECT d.*, source_size, w, target, sum(size) OVER (PARTITION BY d.src ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM d JOIN t ON d.src IS NOT DISTINCT FROM t.src
), e AS (
  SELECT *, (epoch * source_size + upto)::DOUBLE / w AS finish FROM q, range(0, 3) x(epoch) WHERE size > 0
), a AS (
  SELECT *, sum(size) OVER (ORDER BY finish NULLS FIRST, key, src NULLS FIRST, epoch, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) <= (SELECT sum(size) FROM d) AS fits FROM e
), n AS (SELECT r, count(*) FILTER (fits) AS times FROM a GROUP BY r)
SELECT doc_id, size, source_size, target, (size * coalesce(times, 0))::BIGINT AS taken FROM q LEFT JOIN n USING (r)
""",
    "op2_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_Z}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS (SELECT doc_id, n, md5_number(g) AS g FROM (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s)),
h AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))), l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, any_value(len(s))::BIGINT AS n_shingles, min(b) AS component_id FROM s JOIN r ON a = doc_id GROUP BY doc_id
""",
    "op9_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, c, length(h) // 2 AS n, substr(h, 2 * c + 1, 1198) AS h FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 500)) AS c FROM d)),
p AS (SELECT doc_id, c + s AS s, md5_number(substr(h, 2 * s + 1, 200)) AS x FROM (SELECT *, unnest(range(0, least(500, n - c - 99))) AS s FROM c)),
f AS (SELECT x, min((doc_id, s)) AS first FROM p GROUP BY x HAVING count(*) > 1),
q AS (SELECT doc_id, s, (doc_id, s) <> first AS later FROM p JOIN f USING (x)),
g AS (SELECT doc_id, s, coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 < s, true) AS fresh FROM q WHERE later),
n AS (SELECT doc_id, s, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM g),
r AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS e, coalesce(lag(max(s)) OVER (PARTITION BY doc_id ORDER BY run) + 100, 0) AS before FROM n GROUP BY doc_id, run),
k AS (SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS rest, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) AS kept FROM r JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN k.kept IS NULL THEN h ELSE k.kept || substr(h, 2 * rest + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""",
}
