"""Queries on timed and spoken utterances, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import intervals, keywords, quality, sequence, stats
from parley.sources import tables as t

WORD = "[a-z]{2,12}"

U = """u AS (
  SELECT user_id AS meeting_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_type AS speaker,
         epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + round(coalesce(value, 0) * 1000)::BIGINT AS end_ms, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
)"""
S = """s AS (
  SELECT conv_id AS meeting_id, turn AS seq, role AS speaker, text, 100 * coalesce(length(text), 0)::BIGINT AS ms,
         (sum(100 * coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS end_ms FROM conversations
)"""


def speaker_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.speaker_stats(t.event_utterances(spark, d))


def time_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.time_distribution(t.event_utterances(spark, d), 86_400_000)


def _meetings(spark: SparkSession, d: str) -> DataFrame:
    return t.event_utterances(spark, d).groupBy("meeting_id").agg(F.min("created").alias("created"), (F.max("end_ms") - F.min("start_ms")).alias("duration_ms"))


def timeline(spark: SparkSession, d: str) -> DataFrame:
    return stats.timeline(_meetings(spark, d), t.event_utterances(spark, d), "2000-01-01", "2100-12-31")


def speaker_trend(spark: SparkSession, d: str) -> DataFrame:
    return stats.speaker_trend(t.event_utterances(spark, d), "click")


def keyword_trend(spark: SparkSession, d: str) -> DataFrame:
    texts = t.read(spark, d, "documents").select(F.col("doc_id").alias("meeting_id"), F.coalesce("lang", F.lit("?")).alias("lang"), "text")
    return stats.keyword_trend(texts, "th", "lang")


def latest_meetings(spark: SparkSession, d: str) -> DataFrame:
    return stats.latest_meetings(_meetings(spark, d).select("meeting_id", "duration_ms"), t.event_utterances(spark, d), 20)


def speaker_samples(spark: SparkSession, d: str) -> DataFrame:
    return stats.speaker_samples(t.event_utterances(spark, d))


def segment_totals(spark: SparkSession, d: str) -> DataFrame:
    return stats.segment_totals(t.spoken_utterances(spark, d))


def utterance_bounds(spark: SparkSession, d: str) -> DataFrame:
    return stats.bounds(t.spoken_utterances(spark, d))


def distinct_speakers(spark: SparkSession, d: str) -> DataFrame:
    return stats.distinct_speakers(t.event_utterances(spark, d))


def merge_consecutive(spark: SparkSession, d: str) -> DataFrame:
    return sequence.merge_consecutive(t.event_utterances(spark, d), 3_600_000)


def remap_speakers(spark: SparkSession, d: str) -> DataFrame:
    u = t.event_utterances(spark, d).withColumn("speaker", F.when(F.col("speaker") == "error", sequence.UNKNOWN).otherwise(F.col("speaker")))
    return sequence.remap_speakers(u).select("meeting_id", "seq", "speaker", "label")


def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    u = t.event_utterances(spark, d).withColumn("speaker", F.when(F.col("seq") % 3 == 0, F.lit(None)).otherwise(F.col("speaker")))
    return sequence.forward_fill(u).select("meeting_id", "seq", "filled")


def duplicate_ratio(spark: SparkSession, d: str) -> DataFrame:
    return sequence.distinct_texts(t.read(spark, d, "documents").select(F.coalesce("source", F.lit("?")).alias("source"), "text"), "source")


def adjacent_repeats(spark: SparkSession, d: str) -> DataFrame:
    return sequence.repeats(t.spoken_utterances(spark, d))


def segment_windows(spark: SparkSession, d: str) -> DataFrame:
    return sequence.segment_windows(t.event_utterances(spark, d).withColumn("start_ms", F.lit(0).cast("long")).withColumn("end_ms", F.col("start_ms") + F.col("seq") * 137 % 30_000))


def expand_from_longest(spark: SparkSession, d: str) -> DataFrame:
    return sequence.expand_from_longest(t.event_utterances(spark, d), 100_000, 30 * 86_400_000)


def chunk_utterances(spark: SparkSession, d: str) -> DataFrame:
    return sequence.chunk_utterances(t.spoken_utterances(spark, d), 30_000)


def segments_and_turns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    u = t.event_utterances(spark, d)
    segments = u.select("meeting_id", "seq", "start_ms", (F.col("start_ms") + 7_200_000).alias("end_ms"))
    turns = u.select("meeting_id", F.col("seq").alias("turn_idx"), (F.col("start_ms") + 3_600_000).alias("start_ms"), (F.col("start_ms") + 14_400_000).alias("end_ms"), "speaker")
    return segments, turns


def overlap_assign(spark: SparkSession, d: str) -> DataFrame:
    return intervals.assign_by_overlap(*segments_and_turns(spark, d), 86_400_000).select("meeting_id", "seq", "assigned", "overlap_ms")


def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """All utterances of a meeting in the order of their beginning against all in the order of their end."""
    u = t.event_utterances(spark, d)
    got = intervals.positional_zip(u.select("meeting_id", F.col("seq").alias("a")), u.select("meeting_id", F.struct("end_ms", "seq").alias("b")), "meeting_id", "a", "b")
    return got.withColumn("b", F.col("b.seq"))


def top_keywords(spark: SparkSession, d: str) -> DataFrame:
    texts = t.read(spark, d, "documents").select("text", F.col("doc_id").alias("seq"))
    return keywords.top_keywords(texts, None, 50, 2, ["the"], WORD, True)


def compare_two(spark: SparkSession, d: str) -> DataFrame:
    docs = t.read(spark, d, "documents").where(F.col("source").isin("src1", "src2"))
    texts = docs.select(F.when(F.col("source") == "src1", 1).otherwise(2).alias("meeting_id"), F.col("doc_id").alias("seq"), F.col("lang").alias("speaker"), "text")
    return keywords.compare_two(texts, 1, 2, pattern=WORD, lower=True)


def _measured(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = t.spoken_utterances(spark, d).withColumns({"avg_logprob": -(F.col("seq") % 4) / 2.0 - 0.2, "no_speech_prob": (F.col("seq") % 3) / 3.0, "compression_ratio": F.when(F.col("seq") > 0, 2.0 + (F.col("seq") % 2))})
    return s, s.groupBy("meeting_id").agg((F.max("end_ms") * 4).alias("duration_ms"))


def quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    return quality.metrics(*_measured(spark, d)).drop("near_pairs").withColumn("logprob_avg", F.round("logprob_avg", 6))


def quality_issues(spark: SparkSession, d: str) -> DataFrame:
    got = quality.issues(quality.metrics(*_measured(spark, d)))
    return got.select("meeting_id", F.array_join(F.transform("codes", lambda c: F.concat(c["code"], F.lit(":"), c["severity"])), ",").alias("codes"), "severity")


def retry_rules(spark: SparkSession, d: str) -> DataFrame:
    s = t.spoken_utterances(spark, d)
    totals = stats.segment_totals(s).join(s.groupBy("meeting_id").agg((F.max("end_ms") * 3).alias("duration_ms")), "meeting_id")
    return totals.select("meeting_id", quality.retry_without_vad(totals).alias("retry"))


QUERIES = {f.__name__: f for f in (speaker_stats, time_distribution, timeline, speaker_trend, keyword_trend, latest_meetings, speaker_samples, segment_totals, utterance_bounds, distinct_speakers, merge_consecutive, remap_speakers, forward_fill, duplicate_ratio, adjacent_repeats, segment_windows, expand_from_longest, chunk_utterances, overlap_assign, positional_zip, top_keywords, compare_two, quality_metrics, quality_issues, retry_rules)}

NORM = "regexp_replace(lower(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')), '[^0-9a-z가-힣]', '', 'g')"
STRIP = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"

# Neighbours that are alike by difflib's ratio alone are not in the SQL of quality_issues; the conversations hold none.
_MEASURED = f"""{S}, d AS (SELECT meeting_id, max(end_ms) * 4 AS duration_ms FROM s GROUP BY 1),
q AS (SELECT *, length({STRIP}) AS c, nullif(trim(speaker), '') AS who, {NORM} AS x FROM s WHERE length({STRIP}) > 0),
w AS (SELECT meeting_id, who, sum(ms) AS t FROM q WHERE who IS NOT NULL GROUP BY 1, 2), top AS (SELECT meeting_id, max(t)::BIGINT AS top_ms FROM w GROUP BY 1),
x AS (SELECT meeting_id, count(*) AS texts, count(DISTINCT x) AS dt FROM q WHERE length(x) >= 8 GROUP BY 1),
a AS (SELECT meeting_id, count(*) AS n, sum(ms)::BIGINT AS speech_ms, sum(c)::BIGINT AS chars, count(DISTINCT who) AS speakers, count(*) AS logprob_n, avg(-(seq % 4) / 2.0 - 0.2) AS la, count(*) FILTER (-(seq % 4) / 2.0 - 0.2 < -1.1) AS logprob_low,
  count(*) AS silence_n, count(*) FILTER ((seq % 3) / 3.0 >= 0.65) AS silence_high, count(*) FILTER (seq > 0) AS packed_n, count(*) FILTER (seq > 0 AND 2.0 + (seq % 2) >= 2.4) AS packed_high FROM q GROUP BY 1)"""
ORACLE_SQL = {
    "speaker_stats": f"""
WITH {U}, g AS (SELECT meeting_id, coalesce(speaker, '?') AS speaker, count(*) AS n, sum(greatest(end_ms - start_ms, 0))::BIGINT AS total_ms, min(seq) AS f FROM u GROUP BY ALL)
SELECT meeting_id, speaker, n, total_ms, total_ms // n AS avg_ms,
       CASE WHEN sum(total_ms) OVER w > 0 THEN floor(total_ms * 10000 / sum(total_ms) OVER w)::BIGINT ELSE 0 END AS share_bp,
       row_number() OVER (PARTITION BY meeting_id ORDER BY total_ms DESC, f) AS rank FROM g WINDOW w AS (PARTITION BY meeting_id)""",
    "time_distribution": f"""
WITH {U}, b AS (SELECT meeting_id, floor(start_ms / 86400000)::BIGINT AS bin, coalesce(speaker, '?') AS speaker, count(*) AS k, sum(end_ms - start_ms)::BIGINT AS ms, min(seq) AS f, max(end_ms) AS l FROM u GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, bin ORDER BY k DESC, f) AS r, max(l) OVER (PARTITION BY meeting_id) AS e FROM b)
SELECT meeting_id, bin, sum(k)::BIGINT AS n, sum(ms)::BIGINT AS total_ms, max(speaker) FILTER (r = 1) AS top_speaker, max(k) FILTER (r = 1) AS top_n,
       bin * 86400000 AS start_ms, least((bin + 1) * 86400000, max(e)) AS end_ms FROM c GROUP BY meeting_id, bin""",
    "timeline": f"""
WITH {U}, m AS (SELECT meeting_id, min(created) AS created, max(end_ms) - min(start_ms) AS duration_ms, substr(min(created), 1, 7) AS month FROM u GROUP BY 1),
a AS (SELECT month, count(*) AS meetings, sum(duration_ms)::BIGINT AS total_ms FROM m WHERE created >= '2000-01-01' AND created <= '2100-12-31' GROUP BY 1),
b AS (SELECT m.month, count(*) AS utterances FROM m JOIN u USING (meeting_id) GROUP BY 1)
SELECT month, meetings, total_ms, total_ms // meetings AS avg_ms, coalesce(utterances, 0) AS utterances FROM a LEFT JOIN b USING (month)""",
    "speaker_trend": f"WITH {U} SELECT month, count(*) AS n, sum(end_ms - start_ms)::BIGINT AS total_ms, count(DISTINCT meeting_id) AS meetings FROM u WHERE speaker = 'click' GROUP BY 1",
    "keyword_trend": """
WITH k AS (SELECT doc_id, coalesce(lang, '?') AS lang, ((length(text) - length(replace(text, 'th', ''))) // 2)::BIGINT AS k FROM documents)
SELECT lang, sum(k)::BIGINT AS occurrences, count(DISTINCT doc_id) AS meetings FROM k WHERE k > 0 GROUP BY 1""",
    "latest_meetings": f"WITH {U} SELECT meeting_id, max(end_ms) - min(start_ms) AS duration_ms, count(*) AS utterances FROM u GROUP BY 1 ORDER BY 1 DESC LIMIT 20",
    "speaker_samples": f"""
WITH {U}, r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY seq) AS k, row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY seq DESC) AS b FROM u)
SELECT meeting_id, speaker, seq, CASE WHEN k <= 3 THEN 'first' ELSE 'last' END AS part FROM r WHERE k <= 3 OR b <= 2""",
    "segment_totals": f"WITH {S} SELECT meeting_id, count(*) AS n, sum(ms)::BIGINT AS speech_ms, sum(length({STRIP}))::BIGINT AS chars FROM s GROUP BY 1",
    "utterance_bounds": f"WITH {S} SELECT meeting_id, min(end_ms - ms) AS start_ms, max(end_ms) AS end_ms FROM s WHERE length({STRIP}) > 0 GROUP BY 1",
    "distinct_speakers": f"WITH {U} SELECT meeting_id, count(DISTINCT CASE WHEN trim(speaker) <> '' THEN speaker END) AS speakers FROM u GROUP BY 1",
    "merge_consecutive": f"""
WITH {U}, f AS (SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER w AND start_ms - lag(end_ms) OVER w <= 3600000 THEN 0 ELSE 1 END AS new FROM u WINDOW w AS (PARTITION BY meeting_id ORDER BY seq)),
r AS (SELECT *, sum(new) OVER (PARTITION BY meeting_id ORDER BY seq) AS run FROM f)
SELECT meeting_id, min(seq) AS seq, min(speaker) AS speaker, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms, count(*) AS n FROM r GROUP BY meeting_id, run""",
    "remap_speakers": f"""
WITH {U}, v AS (SELECT meeting_id, seq, CASE WHEN speaker = 'error' THEN 'UNKNOWN' ELSE speaker END AS speaker FROM u),
l AS (SELECT meeting_id, speaker, '사용자' || row_number() OVER (PARTITION BY meeting_id ORDER BY min(seq)) AS label FROM v WHERE speaker <> 'UNKNOWN' GROUP BY 1, 2)
SELECT meeting_id, seq, speaker, coalesce(label, '미식별') AS label FROM v LEFT JOIN l USING (meeting_id, speaker)""",
    "forward_fill": f"""
WITH {U} SELECT meeting_id, seq, coalesce(last_value(CASE WHEN seq % 3 <> 0 THEN speaker END IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 'SPEAKER_00') AS filled FROM u""",
    "duplicate_ratio": f"WITH n AS (SELECT coalesce(source, '?') AS source, {NORM} AS x FROM documents) SELECT source, count(*) AS texts, count(DISTINCT x) AS distinct_texts FROM n WHERE length(x) >= 8 GROUP BY 1",
    "segment_windows": f"""
WITH {U}, g AS (SELECT meeting_id, seq, seq * 137 % 30000 AS e FROM u), w AS (SELECT *, unnest(range(0, greatest(0, ceil((e - 2500) / 2100)::BIGINT) + 1)) AS k FROM g WHERE e >= 500)
SELECT meeting_id, seq, k, k * 2100 AS from_ms, least(k * 2100 + 2500, e) AS to_ms FROM w WHERE least(k * 2100 + 2500, e) - k * 2100 >= 500""",
    "overlap_assign": f"""
WITH {U}, p AS (SELECT a.meeting_id, a.seq, b.speaker, least(a.start_ms + 7200000, b.start_ms + 14400000) - greatest(a.start_ms, b.start_ms + 3600000) AS o, b.seq AS t FROM u a JOIN u b
  ON a.meeting_id = b.meeting_id AND b.start_ms + 3600000 < a.start_ms + 7200000 AND a.start_ms < b.start_ms + 14400000),
r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY meeting_id, seq ORDER BY o DESC, t) = 1)
SELECT meeting_id, seq, r.speaker AS assigned, coalesce(o, 0) AS overlap_ms FROM u LEFT JOIN r USING (meeting_id, seq)""",
    "positional_zip": f"""
WITH {U}, a AS (SELECT meeting_id, seq AS a, row_number() OVER (PARTITION BY meeting_id ORDER BY seq) AS pos FROM u), b AS (SELECT meeting_id, seq AS b, row_number() OVER (PARTITION BY meeting_id ORDER BY end_ms, seq) AS pos FROM u)
SELECT meeting_id, pos, a, b FROM a JOIN b USING (meeting_id, pos)""",
    "top_keywords": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS ws FROM documents), x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
c AS (SELECT word, count(*) AS n, min((doc_id, i)) AS p FROM x WHERE word <> 'the' GROUP BY 1)
SELECT word, n, rank FROM (SELECT word, n, row_number() OVER (ORDER BY n DESC, p, word) AS rank FROM c) WHERE rank <= 50 AND n >= 2""",
    "compare_two": f"""
WITH d AS (SELECT CASE WHEN source = 'src1' THEN 1 ELSE 2 END AS m, doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS ws FROM documents WHERE source IN ('src1', 'src2')),
x AS (SELECT m, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d), c AS (SELECT m, word, count(*) AS n, min((doc_id, i)) AS p FROM x GROUP BY 1, 2),
k AS (SELECT 'word' AS kind, m, word AS item, n FROM c QUALIFY row_number() OVER (PARTITION BY m ORDER BY n DESC, p, word) <= 50 UNION ALL SELECT 'speaker', m, lang, count(*) FROM d WHERE lang IS NOT NULL GROUP BY m, lang),
g AS (SELECT kind, item, max(n) FILTER (m = 1) AS a, max(n) FILTER (m = 2) AS b FROM k GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN a IS NULL THEN 'b' WHEN b IS NULL THEN 'a' ELSE 'both' END AS side FROM g)
SELECT kind, side, item, coalesce(a, 0) AS n_a, coalesce(b, 0) AS n_b, row_number() OVER (PARTITION BY kind, side ORDER BY coalesce(a, 0) + coalesce(b, 0) DESC, item) AS rank FROM r
QUALIFY row_number() OVER (PARTITION BY kind, side ORDER BY coalesce(a, 0) + coalesce(b, 0) DESC, item) <= 20""",
    "quality_metrics": f"""
WITH {_MEASURED}
SELECT meeting_id, duration_ms, coalesce(n, 0) AS n, coalesce(speech_ms, 0) AS speech_ms, coalesce(chars, 0) AS chars, coalesce(speakers, 0) AS speakers, coalesce(top_ms, 0) AS top_ms, coalesce(logprob_n, 0) AS logprob_n,
  coalesce(logprob_low, 0) AS logprob_low, round(la, 6) AS logprob_avg, coalesce(silence_n, 0) AS silence_n, coalesce(silence_high, 0) AS silence_high, coalesce(packed_n, 0) AS packed_n, coalesce(packed_high, 0) AS packed_high,
  coalesce(texts, 0) AS texts, coalesce(CASE WHEN texts < 6 THEN texts ELSE dt END, 0) AS distinct_texts
FROM d LEFT JOIN a USING (meeting_id) LEFT JOIN top USING (meeting_id) LEFT JOIN x USING (meeting_id)""",
    "quality_issues": f"""
WITH {_MEASURED}, y AS (SELECT meeting_id, seq, x, lag(x) OVER (PARTITION BY meeting_id ORDER BY seq) AS p FROM q WHERE length(x) >= 8),
np AS (SELECT meeting_id, CASE WHEN count(*) < 6 THEN 0 ELSE count(*) FILTER (x = p OR (least(length(x), length(p)) >= 12 AND (contains(x, p) OR contains(p, x)))) END AS near FROM y GROUP BY 1),
z AS (SELECT meeting_id, duration_ms / 1000.0 AS dur, coalesce(n, 0) AS n, coalesce(speech_ms, 0) / 1000.0 AS sp, coalesce(chars, 0) AS chars, coalesce(speakers, 0) AS speakers, coalesce(top_ms * 1.0 / nullif(speech_ms, 0), 0) AS top,
  coalesce(1 - CASE WHEN texts < 6 THEN texts ELSE dt END * 1.0 / nullif(texts, 0), 0) AS dup, CASE WHEN texts > 1 THEN near * 1.0 / (texts - 1) ELSE 0 END AS near, coalesce(logprob_low * 1.0 / nullif(logprob_n, 0), 0) AS low, coalesce(la, 0) AS la,
  coalesce(silence_high * 1.0 / nullif(silence_n, 0), 0) AS sil, coalesce(packed_high * 1.0 / nullif(packed_n, 0), 0) AS pck FROM d LEFT JOIN a USING (meeting_id) LEFT JOIN top USING (meeting_id) LEFT JOIN x USING (meeting_id) LEFT JOIN np USING (meeting_id)),
k AS (SELECT meeting_id, n, list_filter([
  CASE WHEN dur >= 120 AND n <= 2 THEN 'too_few_utterances:danger' WHEN dur >= 180 AND n / greatest(dur / 60, 1e-6) < 1 THEN 'sparse_utterances:warning' END,
  CASE WHEN dur >= 180 AND sp / greatest(dur, 1e-6) < 0.08 THEN 'low_speech_ratio:danger' WHEN dur >= 180 AND sp / greatest(dur, 1e-6) < 0.15 THEN 'low_speech_ratio:warning' END,
  CASE WHEN dur >= 180 AND chars / greatest(dur / 60, 1e-6) < 40 THEN 'low_text_amount:danger' WHEN dur >= 180 AND chars / greatest(dur / 60, 1e-6) < 90 THEN 'low_text_amount:warning' END,
  CASE WHEN dur >= 300 AND n >= 15 AND speakers <= 1 THEN 'single_speaker_long:warning' WHEN dur >= 300 AND n >= 20 AND speakers >= 2 AND top >= 0.93 THEN 'dominant_speaker:warning' END,
  CASE WHEN dup >= 0.30 OR near >= 0.22 THEN 'repeated_text:danger' WHEN dup >= 0.16 OR near >= 0.12 THEN 'repeated_text:warning' END,
  CASE WHEN low >= 0.35 OR la < -1.15 THEN 'low_asr_confidence:danger' WHEN low >= 0.20 OR la < -0.95 THEN 'low_asr_confidence:warning' END,
  CASE WHEN sil >= 0.30 THEN 'high_no_speech_prob:warning' END, CASE WHEN pck >= 0.20 THEN 'high_compression:warning' END], lambda c: c IS NOT NULL) AS codes FROM z),
l AS (SELECT meeting_id, CASE WHEN n = 0 THEN ['no_speech:danger'] WHEN len(list_filter(codes, lambda c: ends_with(c, ':warning') AND NOT starts_with(c, 'single_speaker') AND NOT starts_with(c, 'dominant'))) >= 2 AND len(list_filter(codes, lambda c: ends_with(c, ':danger'))) = 0 THEN codes || ['combined_quality_risk:danger'] ELSE codes END AS codes FROM k)
SELECT meeting_id, array_to_string(codes, ',') AS codes, CASE WHEN len(list_filter(codes, lambda c: ends_with(c, ':danger'))) > 0 THEN 'danger' WHEN len(codes) > 0 THEN 'warning' ELSE 'ok' END AS severity FROM l""",
    "chunk_utterances": f"""
WITH RECURSIVE {S}, q AS (SELECT meeting_id, seq, end_ms - ms AS start_ms, end_ms, length('[00:00] ' || coalesce(speaker, '?') || ': ' || text) AS size, row_number() OVER (PARTITION BY meeting_id ORDER BY seq) AS k FROM s WHERE length({STRIP}) > 0),
f AS (SELECT meeting_id, seq, k, 0::BIGINT AS chunk, start_ms AS began, size::BIGINT AS chars FROM q WHERE k = 1
  UNION ALL SELECT meeting_id, seq, k, chunk + new, CASE WHEN new = 1 THEN start_ms ELSE began END, CASE WHEN new = 1 THEN size ELSE chars + 1 + size END
  FROM (SELECT q.*, f.chunk, f.began, f.chars, CASE WHEN q.end_ms - f.began >= 30000 OR floor((f.chars + 1 + q.size) * 0.5) + 2048 > 12000 THEN 1 ELSE 0 END AS new FROM f JOIN q ON q.meeting_id = f.meeting_id AND q.k = f.k + 1))
SELECT meeting_id, seq, chunk FROM f""",
    "expand_from_longest": f"""
WITH RECURSIVE {U}, r AS (SELECT meeting_id, speaker, seq, start_ms, end_ms, end_ms - start_ms AS d, row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY seq) AS k FROM u),
a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY d DESC, seq) = 1),
f AS (SELECT *, d AS held, 0 AS picked FROM a
  UNION ALL SELECT n.*, f.held + n.d, f.picked + 1 FROM f JOIN r n ON n.meeting_id = f.meeting_id AND n.speaker IS NOT DISTINCT FROM f.speaker AND n.k = f.k + 1 WHERE f.held < 100000 AND n.start_ms - f.end_ms <= 2592000000),
t AS (SELECT meeting_id, speaker, max(held) AS held, max(picked) AS picked FROM f GROUP BY 1, 2),
b AS (SELECT a.*, t.held, t.picked FROM a JOIN t ON t.meeting_id = a.meeting_id AND t.speaker IS NOT DISTINCT FROM a.speaker
  UNION ALL SELECT n.*, b.held + n.d, b.picked + 1 FROM b JOIN r n ON n.meeting_id = b.meeting_id AND n.speaker IS NOT DISTINCT FROM b.speaker AND n.k = b.k - 1 WHERE b.held < 100000 AND b.start_ms - n.end_ms <= 2592000000)
SELECT meeting_id, speaker, seq, start_ms, end_ms, picked::BIGINT AS picked FROM f UNION ALL SELECT b.meeting_id, b.speaker, b.seq, b.start_ms, b.end_ms, b.picked::BIGINT FROM b JOIN t ON t.meeting_id = b.meeting_id AND t.speaker IS NOT DISTINCT FROM b.speaker WHERE b.picked > t.picked""",
    "retry_rules": f"""
WITH {S}, g AS (SELECT meeting_id, count(*) AS n, sum(ms)::DOUBLE AS speech_ms, sum(length({STRIP})) AS chars, max(end_ms) * 3 / 1000.0 AS dur FROM s GROUP BY 1)
SELECT meeting_id, CASE WHEN dur < 60 THEN false ELSE n = 0 OR chars < 100 OR (dur >= 180 AND n / greatest(dur / 60, 1e-6) < 2.0) OR (dur >= 120 AND speech_ms / 1000.0 / dur < 0.12) END AS retry FROM g""",
}
