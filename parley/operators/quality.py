"""Quality of a meeting's transcript: measures, rules, verdict; and whether to recognise it anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.sequence import repeats
from parley.operators.stats import stripped

SEVERITIES = ("ok", "warning", "danger")
SPEAKER_CODES = ("single_speaker_long", "dominant_speaker")


def metrics(utterances: DataFrame, durations: DataFrame) -> DataFrame:
    """Per meeting of durations (meeting_id, duration_ms): counts that the rules compare, exact. Blank texts do not count.

    n, speech_ms (no negative lengths), chars, speakers (named ones), top_ms (of the speaker who talks most), texts, distinct_texts, near_pairs, and of the
    measures, over the rows that have them: logprob_n, logprob_low (under -1.1), logprob_avg, silence_n, silence_high (0.65 or more),
    packed_n, packed_high (2.4 or more).
    """
    have = set(utterances.columns)
    m = lambda c: F.col(c) if c in have else F.lit(None).cast("double")
    said = utterances.withColumn("said", stripped(F.col("text"))).where(F.length("said") > 0)
    said = said.withColumn("ms", F.greatest(F.coalesce("end_ms", "start_ms") - F.col("start_ms"), F.lit(0))).withColumn("who", F.nullif(F.trim("speaker"), F.lit("")))
    by = said.groupBy("meeting_id", "who").agg(
        F.count("*").alias("k"),
        F.sum("ms").alias("ms"),
        F.sum(F.length("said")).alias("chars"),
        F.count(m("avg_logprob")).alias("ln"),
        F.count_if(m("avg_logprob") < -1.1).alias("ll"),
        F.sum(m("avg_logprob")).alias("ls"),
        F.count(m("no_speech_prob")).alias("sn"),
        F.count_if(m("no_speech_prob") >= 0.65).alias("sh"),
        F.count(m("compression_ratio")).alias("pn"),
        F.count_if(m("compression_ratio") >= 2.4).alias("ph"),
    )
    named = F.when(F.col("who").isNotNull(), F.col("ms"))
    whole = by.groupBy("meeting_id").agg(F.sum("k").alias("n"), F.sum("ms").alias("speech_ms"), F.sum("chars").alias("chars"), F.count("who").alias("speakers"), F.max(named).alias("top_ms"), F.sum("ln").alias("logprob_n"), F.sum("ll").alias("logprob_low"), (F.sum("ls") / F.nullif(F.sum("ln"), F.lit(0))).alias("logprob_avg"), F.sum("sn").alias("silence_n"), F.sum("sh").alias("silence_high"), F.sum("pn").alias("packed_n"), F.sum("ph").alias("packed_high"))
    out = durations.select("meeting_id", "duration_ms").join(whole, "meeting_id", "left").join(repeats(said), "meeting_id", "left")
    return out.fillna(0, [c for c in out.columns if c not in ("meeting_id", "logprob_avg")])


def issues(measured: DataFrame) -> DataFrame:
    """measured (metrics()) with codes: array<struct<code, severity>> in order of the rules, and severity: the worst. Rules compare unrounded values.

    A meeting without utterances has the one issue no_speech. Two warnings or more beside those on speakers make a further one.
    """
    dur, n = F.col("duration_ms") / 1000.0, F.col("n")
    minutes = F.greatest(dur / 60, F.lit(1e-6))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    speech = F.col("speech_ms") / 1000.0 / F.greatest(dur, F.lit(1e-6))
    chars, top = F.col("chars") / minutes, share("top_ms", "speech_ms")
    dup, near = 1 - F.when(F.col("texts") > 0, F.col("distinct_texts") / F.col("texts")).otherwise(1.0), F.when(F.col("texts") > 1, F.col("near_pairs") / (F.col("texts") - 1)).otherwise(0.0)
    low, avg = share("logprob_low", "logprob_n"), F.when(F.col("logprob_n") > 0, F.col("logprob_avg")).otherwise(0.0)

    def rule(code: str | Column, danger: Column | None, warning: Column | None) -> Column:
        no = F.lit(False)
        severity = F.when(F.coalesce(danger if danger is not None else no, no), "danger").when(F.coalesce(warning if warning is not None else no, no), "warning")
        return F.when(severity.isNotNull(), F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), severity.alias("severity")))

    few = (dur >= 120) & (n <= 2)
    long_ = dur >= 180
    single = (dur >= 300) & (n >= 15) & (F.col("speakers") <= 1)
    found = F.filter(
        F.array(
            rule(F.when(few, "too_few_utterances").otherwise("sparse_utterances"), few, long_ & (n / minutes < 1.0)),
            rule("low_speech_ratio", long_ & (speech < 0.08), long_ & (speech < 0.15)),
            rule("low_text_amount", long_ & (chars < 40), long_ & (chars < 90)),
            rule(F.when(single, SPEAKER_CODES[0]).otherwise(SPEAKER_CODES[1]), None, single | ((dur >= 300) & (n >= 20) & (F.col("speakers") >= 2) & (top >= 0.93))),
            rule("repeated_text", (dup >= 0.30) | (near >= 0.22), (dup >= 0.16) | (near >= 0.12)),
            rule("low_asr_confidence", (low >= 0.35) | (avg < -1.15), (low >= 0.20) | (avg < -0.95)),
            rule("high_no_speech_prob", None, share("silence_high", "silence_n") >= 0.30),
            rule("high_compression", None, share("packed_high", "packed_n") >= 0.20),
        ),
        lambda x: x.isNotNull(),
    )
    strong = F.size(F.filter("codes", lambda x: (x["severity"] == "warning") & ~x["code"].isin(*SPEAKER_CODES)))
    combined = F.array(F.struct(F.lit("combined_quality_risk").alias("code"), F.lit("danger").alias("severity")))
    none = F.array(F.struct(F.lit("no_speech").alias("code"), F.lit("danger").alias("severity")))
    dangerous = F.exists("codes", lambda x: x["severity"] == "danger")
    out = measured.withColumn("codes", F.when(n == 0, none).otherwise(found))
    out = out.withColumn("codes", F.when((n > 0) & (strong >= 2) & ~dangerous, F.concat("codes", combined)).otherwise(F.col("codes")))
    return out.withColumn("severity", F.when(dangerous, "danger").when(F.size("codes") > 0, "warning").otherwise("ok"))


def upload_gate(judged: DataFrame, forced: bool = False) -> DataFrame:
    """judged with sync_status: blocked where the verdict is danger, unless forced; else pending."""
    return judged.withColumn("sync_status", F.when((F.col("severity") == "danger") & F.lit(not forced), "blocked").otherwise("pending"))


def retry_without_vad(totals: DataFrame) -> Column:
    """Did voice detection drop too much? totals: n, speech_ms, chars, duration_ms."""
    dur = F.col("duration_ms") / 1000.0
    sparse = (dur >= 180) & (F.col("n") / F.greatest(dur / 60, F.lit(1e-6)) < 2.0)
    quiet = (dur >= 120) & (F.col("speech_ms") / 1000.0 / dur < 0.12)
    return F.when(dur < 60, False).otherwise((F.col("n") == 0) | (F.col("chars") < 100) | sparse | quiet)


def prefer_retry(o: str = "o", r: str = "r") -> Column:
    """Is the second attempt the better one? Columns o.n, o.speech_ms, o.chars, duration_ms and the same of r."""
    c = lambda t, x: F.col(f"{t}.{x}")
    usable = (c(r, "n") > 0) & (c(r, "chars") > 0) & (c(r, "chars") >= F.greatest(F.lit(50), F.floor(c(o, "chars") * 0.8)))
    more_text = (c(r, "chars") >= F.greatest(c(o, "chars") + 100, F.floor(c(o, "chars") * 1.2))) & (c(r, "n") >= c(o, "n"))
    more_rows = (c(r, "n") >= F.greatest(c(o, "n") + 3, F.floor(c(o, "n") * 1.5))) & (c(r, "chars") >= F.floor(c(o, "chars") * 0.9))
    more_talk = (c(r, "speech_ms") >= c(o, "speech_ms") + F.greatest(F.lit(15_000.0), F.col("duration_ms") * 0.1)) & (c(r, "chars") >= c(o, "chars"))
    return usable & (more_text | more_rows | more_talk)
