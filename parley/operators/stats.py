"""Talk statistics: by speaker, by time, by month; archive lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNKNOWN_SPEAKER, UNKNOWN_MONTH = "?", "(미상)"


def _length() -> Column:
    return F.col("end_ms") - F.col("start_ms")


def speaker_stats(utterances: DataFrame) -> DataFrame:
    """Per meeting and speaker: n, total_ms (negative lengths count 0), avg_ms, share_bp of the meeting's total in 1/10000, rank.

    A missing speaker is '?'; where all lengths are 0 the shares are too. rank goes by total, ties by first appearance.
    """
    d = F.greatest(_length(), F.lit(0))
    by = utterances.groupBy("meeting_id", F.coalesce("speaker", F.lit(UNKNOWN_SPEAKER)).alias("speaker")).agg(F.count("*").alias("n"), F.sum(d).alias("total_ms"), F.min("seq").alias("first_seq"))
    whole = F.sum("total_ms").over(W.partitionBy("meeting_id"))
    rank = F.row_number().over(W.partitionBy("meeting_id").orderBy(F.desc("total_ms"), "first_seq"))
    return by.select("meeting_id", "speaker", "n", "total_ms", F.expr("total_ms div n").alias("avg_ms"), F.when(whole > 0, F.floor(F.col("total_ms") * 10000 / whole)).otherwise(0).cast("long").alias("share_bp"), rank.cast("long").alias("rank"))


def time_distribution(utterances: DataFrame, bin_ms: int = 600_000) -> DataFrame:
    """Per meeting and bin of start times: n, total_ms (lengths as they are), top speaker and its count, the bin's bounds (the last ends with the meeting)."""
    u = utterances.withColumn("bin", F.floor(F.col("start_ms") / bin_ms))
    by = u.groupBy("meeting_id", "bin", F.coalesce("speaker", F.lit(UNKNOWN_SPEAKER)).alias("speaker")).agg(F.count("*").alias("k"), F.sum(_length()).alias("ms"), F.min("seq").alias("first_seq"), F.max("end_ms").alias("last_ms"))
    top = F.max_by(F.struct("speaker", "k"), F.struct("k", -F.col("first_seq"))).alias("top")
    bins = by.groupBy("meeting_id", "bin").agg(F.sum("k").alias("n"), F.sum("ms").alias("total_ms"), F.max("last_ms").alias("last_ms"), top)
    end = F.max("last_ms").over(W.partitionBy("meeting_id"))
    return bins.select("meeting_id", "bin", "n", "total_ms", F.col("top.speaker").alias("top_speaker"), F.col("top.k").alias("top_n"), (F.col("bin") * bin_ms).alias("start_ms"), F.least((F.col("bin") + 1) * bin_ms, end).alias("end_ms"))


def within(created: Column, since: str | None, until: str | None) -> Column:
    """Inclusive bounds on ISO strings, as strings: an until of a day leaves out that day's times, which sort after it."""
    ok = F.lit(True)
    if since:
        ok = ok & (created >= since)
    return ok & (created <= until) if until else ok


def timeline(meetings: DataFrame, utterances: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Per month: meetings, total_ms, avg_ms, utterances. The bounds hold for meetings only; utterances of the month all count.

    meetings: meeting_id, created, duration_ms. A meeting without a date falls under '(미상)'.
    """
    month = F.coalesce(F.substring("created", 1, 7), F.lit(UNKNOWN_MONTH))
    of = meetings.select("meeting_id", "duration_ms", "created", month.alias("month"))
    chosen = of.where(within(F.col("created"), since, until)) if since or until else of
    totals = chosen.groupBy("month").agg(F.count("*").alias("meetings"), F.sum(F.coalesce("duration_ms", F.lit(0))).alias("total_ms"))
    counts = of.join(utterances.select("meeting_id", "seq"), "meeting_id").groupBy("month").agg(F.count("seq").alias("utterances"))
    return totals.join(counts, "month", "left").select("month", "meetings", "total_ms", F.expr("total_ms div meetings").alias("avg_ms"), F.coalesce("utterances", F.lit(0)).alias("utterances"))


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping, case-sensitive occurrences of a literal."""
    return F.coalesce(F.lit(0) if not word else (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word), F.lit(0)).cast("long")


def keyword_trend(texts: DataFrame, word: str, by: str = "month") -> DataFrame:
    """Per month: occurrences of word, and meetings with one at least. texts: meeting_id, by, text. Months without any are left out."""
    hits = texts.select("meeting_id", by, occurrences(F.col("text"), word).alias("k")).where("k > 0")
    return hits.groupBy(by).agg(F.sum("k").alias("occurrences"), F.countDistinct("meeting_id").alias("meetings"))


def speaker_trend(utterances: DataFrame, speaker: str) -> DataFrame:
    """Per month, of one speaker: n, total_ms (lengths as they are), meetings."""
    return utterances.where(F.col("speaker") == speaker).groupBy("month").agg(F.count("*").alias("n"), F.sum(_length()).alias("total_ms"), F.countDistinct("meeting_id").alias("meetings"))


def latest_meetings(meetings: DataFrame, utterances: DataFrame, n: int = 20) -> DataFrame:
    """The n meetings with the highest ids, each with its number of utterances (0 if none)."""
    top = meetings.orderBy(F.desc("meeting_id")).limit(n)
    counts = utterances.join(F.broadcast(top.select("meeting_id")), "meeting_id", "left_semi").groupBy("meeting_id").agg(F.count("*").alias("utterances"))  # n ids
    return top.join(counts, "meeting_id", "left").withColumn("utterances", F.coalesce("utterances", F.lit(0)))


def meeting_detail(meetings: DataFrame, utterances: DataFrame, targets: DataFrame, default_target: str = "default") -> DataFrame:
    """Each meeting with its utterances (in order of seq) and targets (the default first, then by time of change) as arrays."""
    lines = utterances.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("seq", "speaker", "start_ms", "end_ms"))).alias("utterances"))
    first = F.when(F.col("target") == default_target, 0).otherwise(1)
    states = targets.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct(first.alias("later"), "updated", "target", "status"))).alias("targets"))
    return meetings.join(lines, "meeting_id", "left").join(states, "meeting_id", "left")


def segment_totals(utterances: DataFrame) -> DataFrame:
    """Per meeting: n, speech_ms (negative lengths count 0), chars of stripped text."""
    return utterances.groupBy("meeting_id").agg(F.count("*").alias("n"), F.sum(F.greatest(_length(), F.lit(0))).alias("speech_ms"), F.sum(F.length(stripped(F.col("text")))).alias("chars"))


def bounds(utterances: DataFrame) -> DataFrame:
    """Per meeting: the first start and the last end of utterances that say something."""
    return utterances.where(F.length(stripped(F.col("text"))) > 0).groupBy("meeting_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def distinct_speakers(utterances: DataFrame) -> DataFrame:
    """Per meeting: how many named speakers; empty names do not count."""
    return utterances.groupBy("meeting_id").agg(F.countDistinct(F.when(F.trim("speaker") != "", F.col("speaker"))).alias("speakers"))


def speaker_samples(utterances: DataFrame, first: int = 3, last: int = 2) -> DataFrame:
    """Of each meeting and speaker the first and the last few utterances."""
    w = W.partitionBy("meeting_id", "speaker")
    k, back = F.row_number().over(w.orderBy("seq")), F.row_number().over(w.orderBy(F.desc("seq")))
    return utterances.withColumns({"k": k, "back": back}).where((F.col("k") <= first) | (F.col("back") <= last)).select("meeting_id", "speaker", "seq", F.when(F.col("k") <= first, "first").otherwise("last").alias("part"))
