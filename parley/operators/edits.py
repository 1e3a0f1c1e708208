"""Changes to stored tables as new snapshots, and how many rows each changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators.numbering import numbered


def update(rows: DataFrame, where: Column, **values: Column) -> tuple[DataFrame, DataFrame]:
    """rows with the columns in values set where the condition holds; and one row: changed, how many rows that are."""
    hit = F.coalesce(where, F.lit(False))
    new = rows.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns))
    return new, rows.agg(F.count_if(hit).alias("changed"))


def set_text(utterances: DataFrame, utterance_id: int, text: str) -> tuple[DataFrame, DataFrame]:
    return update(utterances, F.col("utterance_id") == utterance_id, text=F.lit(text))


def rename_speaker(utterances: DataFrame, meeting_id: int, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    return update(utterances, (F.col("meeting_id") == meeting_id) & (F.col("speaker") == old), speaker=F.lit(new))


def set_summary(meetings: DataFrame, meeting_id: int, title: str | None = None, summary_md: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What is not given stays."""
    given = {k: F.lit(v) for k, v in (("title", title), ("summary_md", summary_md)) if v is not None}
    return update(meetings, F.col("meeting_id") == meeting_id if given else F.lit(False), **given)


def delete_meetings(ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the meetings in ids (meeting_id)."""
    gone = ids.select("meeting_id").distinct()
    return {name: t.join(gone, "meeting_id", "left_anti") for name, t in tables.items()}


def new_meetings(segments: DataFrame, meetings: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows to append for newly recognised meetings. segments: source_file, start_ms, end_ms, speaker, text, place (their order in the file).

    Meetings get ids after the highest of meetings (meeting_id), by source_file; utterances get seq from 0, and uuids.
    """
    top = meetings.agg(F.coalesce(F.max("meeting_id"), F.lit(0)).alias("top"))
    files = segments.groupBy("source_file").agg(F.countDistinct("speaker").alias("speaker_count"), (F.max("end_ms") / 1000).alias("duration_sec"))
    ids = numbered(files, ["source_file"], "k").crossJoin(F.broadcast(top))  # one row: the highest id
    m = ids.select((F.col("top") + F.col("k")).cast("long").alias("meeting_id"), F.uuid().alias("uuid"), (now if now is not None else F.current_timestamp()).alias("created_at"), "source_file", "duration_sec", "speaker_count", F.lit("pending").alias("sync_status"))
    seq = F.row_number().over(W.partitionBy("source_file").orderBy("place")) - 1
    u = segments.join(m.select("source_file", "meeting_id"), "source_file").select("meeting_id", seq.cast("long").alias("seq"), F.uuid().alias("uuid"), "speaker", "start_ms", "end_ms", "text", F.lit("pending").alias("sync_status"))
    return m, u
