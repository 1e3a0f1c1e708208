"""Adapters: stored tables as the frames that the operators take.

Utterances: meeting_id, seq, speaker, start_ms, end_ms and, where known, text, created (UTC) and the recogniser's three measures.
Times are integer milliseconds, so that sums do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The file kinds that are taken for recordings.
AUDIO_SUFFIXES = ("mp3", "m4a", "wav", "amr", "aac", "ogg", "flac", "wma", "mp4")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, in a session on UTC."""
    return F.unix_millis(ts.cast("timestamp"))


def event_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as timed utterances: a user's events are a meeting, the type speaks, the value is the length in seconds."""
    e = read(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    start = millis(F.col("ts"))
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("meeting_id"),
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        F.col("event_type").alias("speaker"),
        start.alias("start_ms"),
        (start + F.round(F.coalesce("value", F.lit(0.0)) * 1000).cast("long")).alias("end_ms"),
        F.date_format(F.col("ts"), "yyyy-MM").alias("month"),
        F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("created"),
    )


def spoken_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as text utterances, on a clock of 100 ms for each character."""
    c = read(spark, sf_dir, "conversations")
    ms = 100 * F.coalesce(F.length("text"), F.lit(0)).cast("long")
    order = W.partitionBy("conv_id").orderBy("turn")
    end = F.sum(ms).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return c.select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), (end - ms).alias("start_ms"), end.alias("end_ms"), F.col("text"))


def documents_as_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a meeting archive: id, title (the source), body (the text)."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("body"))


def order_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as publication state: the customer is the meeting, the priority the target; the latest order of both is the current state."""
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "synced").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    latest = o.groupBy(F.col("o_custkey").alias("meeting_id"), F.col("o_orderpriority").alias("target")).agg(F.max_by(F.struct(status.alias("status"), F.col("o_orderkey").alias("key")), "o_orderkey").alias("s"))
    post = F.when(F.col("s.status") == "synced", F.concat(F.lit("p"), F.col("s.key")))
    error = F.when(F.col("s.status") == "failed", F.concat(F.lit("e"), F.col("s.key") % 7))
    return latest.select("meeting_id", "target", F.col("s.status").alias("status"), post.alias("post_id"), error.alias("error"), F.col("s.key").alias("updated"))


def normalise_segments(rows: DataFrame) -> DataFrame:
    """Segment rows of either naming (start, end in seconds or start_sec, end_sec) as utterances; the three measures become nullable columns."""
    have = set(rows.columns)
    pick = lambda *names: F.coalesce(*[F.col(n).cast("double") for n in names if n in have], F.lit(None).cast("double"))
    start = F.coalesce(pick("start", "start_sec"), F.lit(0.0))
    end = F.coalesce(pick("end", "end_sec"), start)
    ms = lambda c: F.round(c * 1000).cast("long")
    measures = [pick(m).alias(m) for m in ("avg_logprob", "no_speech_prob", "compression_ratio")]
    text = F.col("text") if "text" in have else F.lit(None).cast("string")
    return rows.select("meeting_id", "seq", "speaker", ms(start).alias("start_ms"), ms(end).alias("end_ms"), text.alias("text"), *measures)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header and perhaps a byte order mark; blank cells are null."""
    rows = spark.read.options(header=True, encoding="UTF-8", mode="PERMISSIVE").csv(path) if schema is None else spark.read.schema(schema).options(header=True).csv(path)
    rows = rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))
    return rows.select(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in rows.dtypes))


def read_segments_json(spark: SparkSession, path: str) -> DataFrame:
    """Cached segments: a file holds one JSON array."""
    return spark.read.schema("start double, end double, speaker string, text string, avg_logprob double, no_speech_prob double, compression_ratio double").option("multiLine", True).json(path)


def write_segments_json(segments: DataFrame, path: str) -> None:
    """The cache that read_segments_json reads: start, end, speaker, text and the measures that are there; one array in each file, in order of the start."""
    names = [c for c in ("start", "end", "speaker", "text", "avg_logprob", "no_speech_prob", "compression_ratio") if c in segments.columns]
    by = segments.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("rows"))  # a meeting's segments are one file
    by.select("meeting_id", F.to_json("rows").alias("value")).repartition("meeting_id").write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("meeting_id").text(path)


def audio_glob() -> str:
    return "*.{" + ",".join([*AUDIO_SUFFIXES, *(s.upper() for s in AUDIO_SUFFIXES)]) + "}"


def audio_files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Audio files of a folder, by suffix: path, modificationTime, length."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", audio_glob()).load(path)
    return files if content else files.drop("content")
