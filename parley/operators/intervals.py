"""Interval joins within a meeting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.numbering import kept


def assign_by_overlap(segments: DataFrame, turns: DataFrame, slot_ms: int | None = 60_000) -> DataFrame:
    """Each segment with the speaker of the turn that overlaps it longest (the first of equals), null if none does.

    turns: meeting_id, turn_idx, start_ms, end_ms, speaker. Both sides are cut into time slots, so that a long meeting is joined slot by slot
    on equal keys and not each segment with each turn; an overlap is counted in the slot that it begins in.
    """
    slots = lambda s, e: F.explode(F.sequence(F.floor(s / slot_ms), F.greatest(F.floor(s / slot_ms), F.floor((e - 1) / slot_ms))))
    s = segments.select("meeting_id", "seq", F.col("start_ms").alias("s"), F.col("end_ms").alias("e")).where("e > s")
    t = turns.select("meeting_id", "turn_idx", F.col("start_ms").alias("ts"), F.col("end_ms").alias("te"), F.col("speaker").alias("assigned")).where("te > ts")
    met = s.withColumn("slot", slots(F.col("s"), F.col("e"))).join(t.withColumn("slot", slots(F.col("ts"), F.col("te"))), ["meeting_id", "slot"])
    met = met.where("ts < e and s < te").where(F.col("slot") == F.floor(F.greatest("s", "ts") / slot_ms))
    overlap = F.least("e", "te") - F.greatest("s", "ts")
    best = met.groupBy("meeting_id", "seq").agg(F.max_by("assigned", F.struct(overlap, -F.col("turn_idx"))).alias("assigned"), F.max(overlap).alias("overlap_ms"))
    return segments.join(best, ["meeting_id", "seq"], "left").withColumn("overlap_ms", F.coalesce("overlap_ms", F.lit(0)))


#: Pairs of segments and turns that are weighed at a time.
STRIP = 1_000_000


def _longest(s: np.ndarray, e: np.ndarray, ts: np.ndarray, te: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the place of the turn with the longest overlap, the smallest idx of equals (-1 if none), and that overlap. Turns are sorted by ts."""
    best, length = np.full(len(s), -1, np.int64), np.zeros(len(s), np.int64)
    if not len(ts):
        return best, length
    first = np.searchsorted(np.maximum.accumulate(te), s, "right")  # no turn before it reaches over the segment's begin
    count = np.maximum(np.searchsorted(ts, e, "left") - first, 0)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(count) // STRIP)) + 1, [len(s)]])
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        n = count[lo:hi]
        of = np.repeat(np.arange(lo, hi), n)
        turn = np.repeat(first[lo:hi] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.minimum(e[of], te[turn]) - np.maximum(s[of], ts[turn])
        of, turn, both = of[both > 0], turn[both > 0], both[both > 0]
        order = np.lexsort((idx[turn], -both, of))
        top = order[np.flatnonzero(np.diff(of[order], prepend=-1))]
        best[of[top]], length[of[top]] = turn[top], both[top]
    return best, length


def assign_by_sweep(segments: DataFrame, turns: DataFrame, parts: int | None = None) -> DataFrame:
    """The same as assign_by_overlap, by a sweep over ranges of segments: neither the length of a turn nor a slot's width counts.

    Segments are dealt by ranges of (meeting, begin), so that a long meeting is many tasks. A turn goes to the ranges that it begins or ends in; of the turns that
    are open all through a range, each overlaps every segment there wholly, so that one of them, the first, stands for all and is carried over.
    """
    n = parts or int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = segments.select("meeting_id", "seq", F.col("start_ms").alias("s"), F.col("end_ms").alias("e")).where("e > s")
    s = kept(s.repartitionByRange(n, "meeting_id", "s").withColumn("range", F.spark_partition_id()))
    ranges = kept(s.groupBy("meeting_id", "range").agg(F.min("s").alias("lo"), F.max("e").alias("hi")))  # a row for each range and meeting in it
    t = turns.select("meeting_id", "turn_idx", F.col("start_ms").alias("ts"), F.col("end_ms").alias("te"), F.col("speaker").alias("assigned")).where("te > ts")
    met = t.join(ranges, "meeting_id").where("ts < hi and te > lo")
    ends = met.where("ts > lo or te < hi").select("meeting_id", "range", "turn_idx", "ts", "te", "assigned")
    open_ = met.where("ts <= lo and te >= hi").groupBy("meeting_id", "range").agg(F.min("turn_idx").alias("turn_idx"), F.min("lo").alias("ts"), F.max("hi").alias("te"), F.min_by("assigned", "turn_idx").alias("assigned"))
    there = ends.unionByName(open_).withColumnsRenamed({"meeting_id": "m", "range": "r"})
    kind = segments.sparkSession.createDataFrame([], turns.select("speaker").schema).toArrow().schema.field(0).type

    def sweep(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = [left.column(c).combine_chunks() for c in ("meeting_id", "seq")] if left.num_rows else [pa.array([], f.type) for f in (left.schema.field("meeting_id"), left.schema.field("seq"))]
        if not left.num_rows:
            return pa.table({"meeting_id": columns[0], "seq": columns[1], "assigned": pa.array([], kind), "overlap_ms": pa.array([], pa.int64())})
        right = right.sort_by("ts")
        ts, te, idx = (right.column(c).to_numpy().astype(np.int64) if right.num_rows else np.zeros(0, np.int64) for c in ("ts", "te", "turn_idx"))
        best, length = _longest(left.column("s").to_numpy().astype(np.int64), left.column("e").to_numpy().astype(np.int64), ts, te, idx)
        who = right.column("assigned").combine_chunks().take(pa.array(best, mask=best < 0)) if right.num_rows else pa.nulls(len(best), kind)
        return pa.table({"meeting_id": columns[0], "seq": columns[1], "assigned": who, "overlap_ms": length})

    ids = {c: segments.schema[c].dataType.simpleString() for c in ("meeting_id", "seq")}
    out = s.groupBy("meeting_id", "range").cogroup(there.groupBy("m", "r")).applyInArrow(sweep, f"meeting_id {ids['meeting_id']}, seq {ids['seq']}, assigned {turns.schema['speaker'].dataType.simpleString()}, overlap_ms long")
    return segments.join(out, ["meeting_id", "seq"], "left").withColumn("overlap_ms", F.coalesce("overlap_ms", F.lit(0)))


def positional_zip(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """Rows of left and right paired by position within key, only where both have as many."""
    from pyspark.sql import Window as W

    number = lambda df, o: df.withColumn("pos", F.row_number().over(W.partitionBy(key).orderBy(o))).withColumn("n", F.count("*").over(W.partitionBy(key)))
    return number(left, left_order).join(number(right, right_order), [key, "pos", "n"]).drop("n")
