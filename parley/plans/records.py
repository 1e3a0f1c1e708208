"""Queries on rules, replies, publication, boards, enrolment and stored rows; with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import dictionary, text
from parley.operators import board, edits, keywords, quality, stats, sync, vectors
from parley.plans.archive import T, _states
from parley.plans.talk import S, STRIP, U
from parley.sources import export
from parley.sources import tables as t

# ---- targets and meetings


def target_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The urgent target of every customer in debt."""
    keys = t.read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("meeting_id"), F.lit("1-URGENT").alias("target"))
    return sync.lookup(t.order_targets(spark, d), keys, ["meeting_id", "target"])


def _told(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "customer").where("c_custkey % 4 = 1").select(F.col("c_custkey").alias("meeting_id"), F.concat(F.lit("no reply "), "c_custkey").alias("error"))


def _with_errors(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).withColumn("sync_error", F.when(F.col("sync_status") == "blocked", "quality"))


def failed_meetings(spark: SparkSession, d: str) -> DataFrame:
    return sync.mark_failed(_with_errors(spark, d), _told(spark, d))


def blocked_targets(spark: SparkSession, d: str) -> DataFrame:
    m, s = sync.block(_with_errors(spark, d), t.order_targets(spark, d), _told(spark, d), ["1-URGENT", "extra"], F.lit(0).cast("long"))
    return m.select("meeting_id", F.lit("").alias("target"), F.col("sync_status").alias("status"), F.lit(None).cast("string").alias("post_id"), F.col("sync_error").alias("error")).unionByName(s.drop("updated"))


def approved_meetings(spark: SparkSession, d: str) -> DataFrame:
    targets = t.order_targets(spark, d).withColumn("status", F.when(F.col("target") == "5-LOW", "blocked").otherwise(F.col("status")))
    ids = t.read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("meeting_id"))
    m, s, changed = sync.approve(_with_errors(spark, d), targets, ids)
    hit = changed.withColumn("released", F.lit(True))
    rows = m.select("meeting_id", F.lit("").alias("target"), F.col("sync_status").alias("status"), F.col("sync_error").alias("error")).unionByName(s.select("meeting_id", "target", "status", "error"))
    return rows.join(hit, "meeting_id", "left").withColumn("released", F.coalesce("released", F.lit(False)))


def new_meetings(spark: SparkSession, d: str) -> DataFrame:
    u = t.event_utterances(spark, d).select(F.concat(F.lit("rec"), F.lpad(F.col("meeting_id").cast("string"), 8, "0"), F.lit(".wav")).alias("source_file"), "start_ms", "end_ms", "speaker", F.lit("x").alias("text"), F.col("seq").alias("place"))
    m, rows = edits.new_meetings(u, t.read(spark, d, "customer").select(F.col("c_custkey").alias("meeting_id")))
    return rows.join(m.select("meeting_id", "source_file", "speaker_count", "duration_sec"), "meeting_id").select("meeting_id", "source_file", "speaker_count", F.round("duration_sec", 3).alias("duration_sec"), "seq", "speaker", "sync_status")


def set_text(spark: SparkSession, d: str) -> DataFrame:
    c = t.read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("utterance_id"), "text")
    rows, changed = edits.set_text(c, 101, "said anew")
    return rows.crossJoin(F.broadcast(changed))


def set_summary(spark: SparkSession, d: str) -> DataFrame:
    m = t.read(spark, d, "documents").select(F.col("doc_id").alias("meeting_id"), F.col("source").alias("title"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("summary_md"))
    return edits.set_summary(m, 5, summary_md="short")[0]


def utterance_filter(spark: SparkSession, d: str) -> DataFrame:
    c = t.read(spark, d, "conversations")
    return c.where(F.col("role").isin("user", "system") & keywords.contains_any(F.col("text"), ["the", "Th"])).select("conv_id", "turn")


# ---- rules and prompts


def _rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return t.read(spark, d, "nation").select(k.cast("long").alias("id"), F.col("n_name").alias("term"), F.when(k % 2 == 0, F.lower("n_name")).alias("pattern"), F.lit(None).cast("string").alias("replacement"), F.when(k % 5 == 0, "team").otherwise("global").alias("scope"), (k % 3 != 0).alias("enabled"))


def active_rules(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.active(_rules(spark, d), "team").select("id", "term", "pattern")


def vocabulary_prompt(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.prompt(_rules(spark, d), "team")


def upsert_terms(spark: SparkSession, d: str) -> DataFrame:
    n = t.read(spark, d, "nation").where("n_nationkey % 2 = 0")
    known = n.select(F.col("n_name").alias("term"), F.lower("n_name").alias("pattern"), F.lit("new").alias("replacement"), F.when(F.col("n_nationkey") % 5 == 0, "team").otherwise("global").alias("scope"), F.lit("").alias("notes"))
    other = t.read(spark, d, "region").select(F.col("r_name").alias("term"), F.lit(None).cast("string").alias("pattern"), F.lit("R").alias("replacement"), F.lit("global").alias("scope"), F.lit("").alias("notes"))
    return dictionary.upsert_terms(_rules(spark, d), known.unionByName(other))


def filename_terms(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("p_name"), F.lit("_full("), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit(") 회의-"), F.col("p_partkey").cast("string"), F.lit(" "), F.lower("p_brand"))
    terms = text.filename_terms(name)
    return t.read(spark, d, "part").select("p_partkey", F.array_join(terms, "|").alias("terms"), text.recogniser_prompt(F.col("p_type"), terms, 60).alias("prompt"))


def safe_corrections(spark: SparkSession, d: str) -> DataFrame:
    c = t.read(spark, d, "conversations")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  "), F.reverse("text"), F.lit(" "))).when(F.col("turn") % 3 == 1, F.repeat("text", 4)).otherwise(" ")
    return c.select("conv_id", "turn", dictionary.safe_correction(F.col("text"), said).alias("text"))


# ---- replies and summaries


def _bare(c: str) -> F.Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9 .\\n]", "")


def summary_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies of five kinds: whole, fenced, cut off, with quotes that are not escaped, without braces."""
    body = F.replace(_bare("text"), F.lit("\n"), F.lit("\\n"))
    start = F.concat(F.lit('{"title": "Doc '), F.col("doc_id").cast("string"), F.lit('", "summary_md": "'), body)
    kind = F.pmod("doc_id", F.lit(5))
    raw = F.when(kind == 0, F.concat(start, F.lit('"}'))).when(kind == 1, F.concat(F.lit("```json\n"), start, F.lit('"}\n```'))).when(kind == 2, start).when(kind == 3, F.concat(start, F.lit(' said "so" twice"}'))).otherwise(body)
    got = text.checked_summary(raw, ("the",), 400)
    return t.read(spark, d, "documents").select("doc_id", got["title"].alias("title"), F.md5(got["summary_md"].cast("binary")).alias("digest"), got["problem"].alias("problem"))


def summary_thresholds(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderkey") % 9000
    h = "## 결정 사항"
    return t.read(spark, d, "orders").select("o_orderkey", text.least_summary_chars(s).alias("summary"), text.least_section_chars(s, h, 200).alias("section"), text.least_section_chars(s, "## other", 500).alias("other"), F.size(text.missing_headings(F.concat(F.lit(h + " "), F.col("o_orderpriority")))).alias("missing"))


def chunk_titles(spark: SparkSession, d: str) -> DataFrame:
    c = t.read(spark, d, "conversations")
    title = F.when(F.col("turn") % 3 == 0, "회의록").when(F.col("turn") % 3 == 1, " ").otherwise(F.concat(F.lit(" "), F.col("role"), F.col("turn").cast("string")))
    return text.title_of_chunks(c.select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("chunk"), title.alias("title")))


def chunk_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    c = t.read(spark, d, "conversations")
    got = text.chunk_fallback(F.col("turn"), F.concat_ws("-", "conv_id", "turn"), F.coalesce("text", F.lit("")))
    return c.select("conv_id", "turn", got["title"].alias("title"), F.md5(got["summary_md"].cast("binary")).alias("digest"))


def markdown_lines(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat(F.lit("# <"), F.col("p_name"), F.lit(">\n- **"), F.col("p_brand"), F.lit("** & *"), F.col("p_type"), F.lit("*\n- b\n\nend"))
    return t.read(spark, d, "part").select("p_partkey", export.markdown_html(x).alias("html"))


def hangul_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with Hangul for some letters, so that runs of it occur."""
    said = F.translate(F.coalesce("text", F.lit("")), "aeiourst", "가나다라마바사아")
    texts = t.read(spark, d, "conversations").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), said.alias("text"))
    return keywords.top_keywords(texts, ["role"], 20, 2)


# ---- quality gates


def _judged(spark: SparkSession, d: str) -> DataFrame:
    m = t.event_utterances(spark, d).groupBy("meeting_id").agg(F.count("*").alias("n"))
    return m.withColumn("severity", F.when(F.col("n") % 3 == 0, "danger").when(F.col("n") % 3 == 1, "warning").otherwise("ok"))


def upload_gate(spark: SparkSession, d: str) -> DataFrame:
    return quality.upload_gate(_judged(spark, d)).unionByName(quality.upload_gate(_judged(spark, d), True))


def prefer_retry(spark: SparkSession, d: str) -> DataFrame:
    s = t.spoken_utterances(spark, d)
    o = stats.segment_totals(s.where("seq > 0")).alias("o")
    r = stats.segment_totals(s).withColumn("chars", F.when(F.col("meeting_id") % 3 == 0, F.floor(F.col("chars") / 2)).otherwise(F.col("chars"))).alias("r")
    both = o.join(r, F.col("o.meeting_id") == F.col("r.meeting_id")).join(s.groupBy("meeting_id").agg((F.max("end_ms") * 2).alias("duration_ms")).alias("l"), F.col("l.meeting_id") == F.col("o.meeting_id"))
    return both.select(F.col("o.meeting_id").alias("meeting_id"), quality.prefer_retry().alias("retry"))


# ---- boards


def _board(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("board_id"), F.col("o_orderpriority").alias("marker"), (-F.col("o_orderkey")).alias("number"))
    line = t.read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("comment_id"), (F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 10**9).otherwise(0)).alias("post_id"), F.col("l_linenumber").cast("long").alias("number"))
    return o, line


def comment_parents(spark: SparkSession, d: str) -> DataFrame:
    posts, comments = _board(spark, d)
    return board.with_parent(comments, posts).select("comment_id", "post_id", "parent_marker")


def comment_counters(spark: SparkSession, d: str) -> DataFrame:
    return board.comment_counters(*_board(spark, d))


def board_counts(spark: SparkSession, d: str) -> DataFrame:
    posts, comments = _board(spark, d)
    now = posts.join(comments.groupBy("post_id").agg(F.count("*").alias("k")), "post_id", "left").groupBy("board_id").agg(F.count("*").alias("posts"), (F.sum(F.coalesce("k", F.lit(0))) - 20).alias("comments"))
    return board.counts_after_delete(now, comments, posts.where("marker in ('1-URGENT', '2-HIGH')"))


def post_numbers(spark: SparkSession, d: str) -> DataFrame:
    posts, _ = _board(spark, d)
    new = t.read(spark, d, "customer").select((F.col("c_custkey") % 50 + F.col("c_custkey") % 2 * 10**6).alias("board_id"), F.col("c_custkey").alias("post"))
    return board.numbered_posts(posts, new, "post")


# ---- speakers


def enrol(spark: SparkSession, d: str) -> DataFrame:
    e = t.read(spark, d, "embeddings")
    of = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"), F.max_by("embedding", "vec_id").alias("last"), F.count("*").alias("samples"))
    name = F.concat(F.lit("s"), "label")
    registry = of.where("label % 4 <> 1").select(name.alias("name"), F.col("first").cast("array<double>").alias("embedding"), "samples")
    got = vectors.enrol(registry, of.where("label % 4 <> 2").select(name.alias("name"), F.col("last").alias("embedding")))
    return got.select("name", "samples", F.posexplode("embedding").alias("i", "x")).select("name", "samples", "i", F.round("x", 5).alias("x"))


def compare_totals(spark: SparkSession, d: str) -> DataFrame:
    return keywords.compare_totals(t.event_utterances(spark, d), 3, 7)


QUERIES = {f.__name__: f for f in (target_lookup, failed_meetings, blocked_targets, approved_meetings, new_meetings, set_text, set_summary, utterance_filter, active_rules, vocabulary_prompt, upsert_terms, filename_terms, safe_corrections, summary_replies, summary_thresholds, chunk_titles, chunk_fallbacks, markdown_lines, hangul_keywords, upload_gate, prefer_retry, comment_parents, comment_counters, board_counts, post_numbers, enrol, compare_totals)}

_M = "m AS (SELECT c_custkey AS meeting_id, CASE WHEN c_custkey % 10 = 0 THEN 'blocked' ELSE 'pending' END AS sync_status, CASE WHEN c_custkey % 10 = 0 THEN 'quality' END AS sync_error FROM customer)"
_E = "e AS (SELECT c_custkey AS meeting_id, 'no reply ' || c_custkey AS error FROM customer WHERE c_custkey % 4 = 1)"
_R = "r AS (SELECT n_nationkey::BIGINT AS id, n_name AS term, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) END AS pattern, NULL::VARCHAR AS replacement, CASE WHEN n_nationkey % 5 = 0 THEN 'team' ELSE 'global' END AS scope, n_nationkey % 3 <> 0 AS enabled FROM nation)"
_B = "p AS (SELECT o_orderkey AS post_id, o_custkey AS board_id, o_orderpriority AS marker, -o_orderkey AS number FROM orders), c AS (SELECT l_orderkey * 10 + l_linenumber AS comment_id, l_orderkey + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END AS post_id, l_linenumber::BIGINT AS number FROM lineitem)"

ORACLE_SQL = {
    "target_lookup": f"WITH {T} SELECT * FROM t WHERE target = '1-URGENT' AND meeting_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "failed_meetings": f"WITH {_M}, {_E} SELECT meeting_id, CASE WHEN error IS NULL THEN sync_status ELSE 'failed' END AS sync_status, coalesce(error, sync_error) AS sync_error FROM m LEFT JOIN e USING (meeting_id)",
    "blocked_targets": f"""
WITH {_M}, {_E}, {T}, n AS (SELECT meeting_id, unnest(['1-URGENT', 'extra']) AS target, error FROM e)
SELECT meeting_id, '' AS target, CASE WHEN error IS NULL THEN sync_status ELSE 'blocked' END AS status, NULL::VARCHAR AS post_id, coalesce(error, sync_error) AS error FROM m LEFT JOIN e USING (meeting_id)
UNION ALL SELECT meeting_id, target, CASE WHEN n.error IS NULL THEN t.status ELSE 'blocked' END, t.post_id, coalesce(n.error, t.error) FROM t FULL JOIN n USING (meeting_id, target)""",
    "approved_meetings": f"""
WITH {_M}, {T}, x AS (SELECT meeting_id FROM m JOIN customer ON c_custkey = meeting_id WHERE c_acctbal > 0 AND sync_status = 'blocked'),
s AS (SELECT meeting_id, '' AS target, sync_status AS status, sync_error AS error FROM m UNION ALL SELECT meeting_id, target, CASE WHEN target = '5-LOW' THEN 'blocked' ELSE status END, error FROM t), y AS (SELECT *, meeting_id IN (FROM x) AS released FROM s)
SELECT meeting_id, target, CASE WHEN released AND status = 'blocked' THEN 'pending' ELSE status END AS status, CASE WHEN NOT (released AND status = 'blocked') THEN error END AS error, released FROM y""",
    "new_meetings": f"""
WITH {U}, f AS (SELECT meeting_id AS k, 'rec' || lpad(meeting_id::VARCHAR, 8, '0') || '.wav' AS source_file, count(DISTINCT speaker) AS speaker_count, round(max(end_ms) / 1000, 3) AS duration_sec FROM u GROUP BY ALL),
m AS (SELECT *, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY source_file) AS id FROM f)
SELECT id AS meeting_id, source_file, speaker_count, duration_sec, seq, speaker, 'pending' AS sync_status FROM u JOIN m ON k = meeting_id""",
    "set_text": "SELECT conv_id * 100 + turn AS utterance_id, CASE WHEN conv_id * 100 + turn = 101 THEN 'said anew' ELSE text END AS text, count(*) FILTER (conv_id * 100 + turn = 101) OVER () AS changed FROM conversations",
    "set_summary": "SELECT doc_id AS meeting_id, source AS title, CASE WHEN doc_id = 5 THEN 'short' ELSE md5(coalesce(text, '')) END AS summary_md FROM documents",
    "utterance_filter": "SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'system') AND (contains(text, 'the') OR contains(text, 'Th'))",
    "active_rules": f"WITH {_R} SELECT id, term, pattern FROM r WHERE enabled",
    "vocabulary_prompt": f"WITH {_R}, s AS (SELECT '이 회의에서 등장하는 용어: ' || string_agg(term, ', ' ORDER BY id) || '.' AS t FROM r WHERE enabled) SELECT CASE WHEN length(t) > 224 THEN left(t, 223) || '.' ELSE coalesce(t, '') END AS prompt FROM s",
    "upsert_terms": f"""
WITH {_R} SELECT id, term, pattern, CASE WHEN id % 2 = 0 THEN 'new' END AS replacement, scope, enabled OR id % 2 = 0 AS enabled FROM r
UNION ALL SELECT (SELECT max(id) FROM r) + row_number() OVER (ORDER BY r_name), r_name, NULL, 'R', 'global', true FROM region""",
    "filename_terms": r"""
WITH n AS (SELECT p_partkey, p_type, p_name || '_full' || ' ' || ' 회의-' || p_partkey || ' ' || lower(p_brand) AS s FROM part),
w AS (SELECT p_partkey, p_type, list_filter(list_transform(regexp_split_to_array(s, '[\s\[\]\(\),/&·|_+\-]+'), lambda x: trim(x, ' .!?:;"''')), lambda x: length(x) >= 2 AND lower(x) NOT IN ('회의', 'full') AND NOT regexp_matches(x, '^\d{4,}$')) AS ws FROM n),
u AS (SELECT p_partkey, p_type, list_filter(ws, lambda x, i: list_position(ws, x) = i)[1:12] AS ws FROM w)
SELECT p_partkey, array_to_string(ws, '|') AS terms, left(trim(CASE WHEN len(ws) > 0 THEN '파일명 힌트: ' || array_to_string(ws, ', ') || '. ' ELSE '' END || p_type), 60) AS prompt FROM u""",
    "safe_corrections": """
WITH c AS (SELECT *, CASE turn % 3 WHEN 0 THEN trim(reverse(text)) WHEN 1 THEN trim(repeat(text, 4)) ELSE '' END AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN n = '' OR length(n) > greatest(2 * length(text) + 20, 40) THEN text ELSE n END AS text FROM c""",
    "summary_replies": r"""
WITH d AS (SELECT doc_id, doc_id % 5 AS kind, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .\n]', '', 'g') AS b FROM documents),
s AS (SELECT doc_id, kind, CASE kind WHEN 4 THEN NULL WHEN 3 THEN regexp_replace(b || ' said "so" twice', '^\s+|\s+$', '', 'g') ELSE regexp_replace(b, '^\s+|\s+$', '', 'g') END AS b FROM d)
SELECT doc_id, CASE WHEN b <> '' THEN 'Doc ' || doc_id END AS title, CASE WHEN b <> '' THEN md5(b) END AS digest, CASE WHEN b IS NULL THEN 'unreadable' WHEN b = '' THEN 'empty' WHEN NOT contains(b, 'the') THEN 'headings' WHEN length(b) < 400 THEN 'short' END AS problem FROM s""",
    "summary_thresholds": """
SELECT o_orderkey, CASE WHEN s >= 5400 THEN 3000 WHEN s >= 1800 THEN 2000 ELSE 800 END AS summary, CASE WHEN s < 900 THEN 160 ELSE 200 END AS section, 500 AS other, 5 AS missing FROM (SELECT o_orderkey, o_orderkey % 9000 AS s FROM orders)""",
    "chunk_titles": "SELECT conv_id AS meeting_id, coalesce(arg_min(role || turn, turn) FILTER (turn % 3 = 2), '회의록') AS title FROM conversations GROUP BY 1",
    "chunk_fallbacks": "SELECT conv_id, turn, '구간 ' || turn || ' 원문 발화 보존' AS title, md5('## 구간 개요' || chr(10) || '- ' || conv_id || '-' || turn || ' 구간은 요약을 얻지 못해 발화 원문을 그대로 둡니다.' || chr(10) || chr(10) || '## 발화 원문' || chr(10) || coalesce(text, '')) AS digest FROM conversations",
    "markdown_lines": "SELECT p_partkey, '<h1>&lt;' || p_name || '&gt;</h1>' || chr(10) || '<ul>' || chr(10) || '<li><strong>' || p_brand || '</strong> &amp; <em>' || p_type || '</em></li>' || chr(10) || '<li>b</li>' || chr(10) || '</ul>' || chr(10) || '<p>end</p>' AS html FROM part",
    "hangul_keywords": """
WITH w AS (SELECT role, conv_id * 1000 + turn AS seq, regexp_extract_all(translate(coalesce(text, ''), 'aeiourst', '가나다라마바사아'), '[가-힣]{2,12}') AS ws FROM conversations),
x AS (SELECT role, seq, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w), c AS (SELECT role, word, count(*) AS n, min((seq, i)) AS p FROM x GROUP BY 1, 2)
SELECT role, word, n, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, p, word) AS r FROM c) WHERE r <= 20 AND n >= 2""",
    "upload_gate": f"""
WITH {U}, j AS (SELECT meeting_id, count(*) AS n FROM u GROUP BY 1), k AS (SELECT *, CASE n % 3 WHEN 0 THEN 'danger' WHEN 1 THEN 'warning' ELSE 'ok' END AS severity FROM j)
SELECT *, CASE severity WHEN 'danger' THEN 'blocked' ELSE 'pending' END AS sync_status FROM k UNION ALL SELECT *, 'pending' FROM k""",
    "prefer_retry": f"""
WITH {S}, q AS (SELECT meeting_id, seq, ms, length({STRIP}) AS c, end_ms FROM s),
a AS (SELECT meeting_id, count(*) FILTER (seq > 0) AS n1, count(*) AS n2, sum(ms) FILTER (seq > 0) AS m1, sum(ms) AS m2, sum(c) FILTER (seq > 0) AS c1, sum(c) AS c2, max(end_ms) * 2 AS l FROM q GROUP BY 1 HAVING count(*) FILTER (seq > 0) > 0),
b AS (SELECT * REPLACE (CASE WHEN meeting_id % 3 = 0 THEN c2 // 2 ELSE c2 END AS c2) FROM a)
SELECT meeting_id, c2 > 0 AND c2 >= greatest(50, floor(c1 * 0.8)) AND ((c2 >= greatest(c1 + 100, floor(c1 * 1.2)) AND n2 >= n1) OR (n2 >= greatest(n1 + 3, floor(n1 * 1.5)) AND c2 >= floor(c1 * 0.9)) OR (m2 >= m1 + greatest(15000, l * 0.1) AND c2 >= c1)) AS retry FROM b""",
    "comment_parents": f"WITH {_B} SELECT comment_id, c.post_id AS post_id, marker AS parent_marker FROM c LEFT JOIN p USING (post_id)",
    "comment_counters": f"WITH {_B} SELECT p.post_id AS post_id, count(comment_id) AS comments, coalesce(max(c.number), 0) + 1 AS next_number FROM p LEFT JOIN c USING (post_id) GROUP BY 1",
    "board_counts": f"""
WITH {_B}, k AS (SELECT board_id, post_id, marker IN ('1-URGENT', '2-HIGH') AS gone, (SELECT count(*) FROM c WHERE c.post_id = p.post_id) AS n FROM p)
SELECT board_id, count(*) FILTER (NOT gone) AS posts, greatest(sum(n) - 20 - coalesce(sum(n) FILTER (gone), 0), 0)::BIGINT AS comments FROM k GROUP BY 1""",
    "post_numbers": f"""
WITH {_B}, n AS (SELECT c_custkey % 50 + c_custkey % 2 * 1000000 AS board_id, c_custkey AS post FROM customer), l AS (SELECT board_id, min(number) AS least FROM p GROUP BY 1)
SELECT n.board_id AS board_id, post, coalesce(least, 0) - row_number() OVER (PARTITION BY n.board_id ORDER BY post) AS number FROM n LEFT JOIN l USING (board_id)""",
    "enrol": """
WITH g AS (SELECT label, arg_min(embedding, vec_id) AS a, arg_max(embedding, vec_id) AS b, count(*) AS n FROM embeddings GROUP BY 1),
x AS (SELECT label, n, unnest(a)::DOUBLE AS a, unnest(b)::DOUBLE AS b, generate_subscripts(a, 1) - 1 AS i FROM g),
y AS (SELECT label, i, CASE WHEN label % 4 = 2 THEN n WHEN label % 4 = 1 THEN 1 ELSE n + 1 END AS samples, CASE WHEN label % 4 = 2 THEN a WHEN label % 4 = 1 THEN b ELSE (a * n + b) / (n + 1) END AS m FROM x)
SELECT 's' || label AS name, samples, i, round(CASE WHEN label % 4 = 2 THEN m ELSE m / sqrt(sum(m * m) OVER (PARTITION BY label)) END, 5) AS x FROM y""",
    "compare_totals": f"""
WITH {U} SELECT meeting_id, max(end_ms) - min(start_ms) AS duration_ms, count(DISTINCT speaker) AS speakers, count(*) AS utterances FROM u WHERE meeting_id IN (3, 7) GROUP BY 1""",
}
