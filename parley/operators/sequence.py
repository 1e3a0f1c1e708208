"""Operators on the order of utterances within a meeting. Every window is partitioned by meeting: there is no global sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators.numbering import kept, numbered

UNKNOWN = "UNKNOWN"
# How numbered and unidentified speakers are shown.
NUMBERED, UNIDENTIFIED = "사용자", "미식별"


def _order() -> W:
    return W.partitionBy("meeting_id").orderBy("seq")


def merge_consecutive(utterances: DataFrame, gap_ms: int = 1000) -> DataFrame:
    """Joins neighbours of one speaker whose pause is gap_ms at most.

    A run's text is joined by spaces, its end is its last row's; of the recogniser's measures it keeps the worst. The columns
    text, avg_logprob, no_speech_prob and compression_ratio are carried where they exist.
    """
    w = _order()
    near = F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) & (F.col("start_ms") - F.lag("end_ms").over(w) <= gap_ms)
    runs = utterances.withColumn("run", F.sum(F.when(near, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    have = set(utterances.columns)
    out = [F.min("seq").alias("seq"), F.first("speaker").alias("speaker"), F.min_by("start_ms", "seq").alias("start_ms"), F.max_by("end_ms", "seq").alias("end_ms"), F.count("*").alias("n")]
    if "text" in have:
        out.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"))
    out += [f(c).alias(c) for c, f in (("avg_logprob", F.min), ("no_speech_prob", F.max), ("compression_ratio", F.max)) if c in have]
    return runs.groupBy("meeting_id", "run").agg(*out).drop("run")


def remap_speakers(utterances: DataFrame) -> DataFrame:
    """Adds label: speakers numbered by first appearance; an unknown one takes no number."""
    known = F.col("speaker").isNotNull() & (F.col("speaker") != UNKNOWN)
    first = utterances.where(known).groupBy("meeting_id", "speaker").agg(F.min("seq").alias("first_seq"))
    number = F.row_number().over(W.partitionBy("meeting_id").orderBy("first_seq"))
    labels = first.select("meeting_id", "speaker", F.concat(F.lit(NUMBERED), number.cast("string")).alias("label"))
    return utterances.join(labels, ["meeting_id", "speaker"], "left").withColumn("label", F.coalesce("label", F.lit(UNIDENTIFIED)))


def forward_fill(rows: DataFrame, column: str = "speaker", into: str = "filled", initial: str = "SPEAKER_00") -> DataFrame:
    """The last value known so far in the meeting, initial before the first."""
    last = F.last(column, ignorenulls=True).over(_order().rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn(into, F.coalesce(last, F.lit(initial)))


def normalised(text: Column) -> Column:
    """Lower case without white space, of digits, Latin and Hangul letters only."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")), "[^0-9a-z가-힣]", "")


def distinct_texts(rows: DataFrame, key: str, least: int = 8) -> DataFrame:
    """Per key over normalised texts of least characters or more: texts, distinct_texts."""
    texts = rows.select(key, normalised(F.col("text")).alias("t")).where(F.length("t") >= least)
    return texts.groupBy(key).agg(F.count("*").alias("texts"), F.countDistinct("t").alias("distinct_texts"))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def repeats(utterances: DataFrame, least: int = 8, contained: int = 12, ratio: float = 0.86, enough: int = 6) -> DataFrame:
    """Per meeting over normalised texts of least characters or more: texts, distinct_texts, near_pairs (neighbours that are equal,
    one within the other if the shorter has contained characters, or alike by ratio). Meetings with fewer than enough texts have no pairs."""
    texts = utterances.select("meeting_id", "seq", normalised(F.col("text")).alias("t")).where(F.length("t") >= least)
    pairs = texts.withColumn("p", F.lag("t").over(_order()))
    inside = (F.least(F.length("t"), F.length("p")) >= contained) & (F.col("t").contains(F.col("p")) | F.col("p").contains(F.col("t")))
    easy = F.coalesce((F.col("t") == F.col("p")) | inside, F.lit(False))
    unsure = ~easy & F.col("p").isNotNull() & (200 * F.least(F.length("t"), F.length("p")) >= F.lit(100 * ratio) * (F.length("t") + F.length("p")))
    ratio_of = F.pandas_udf(_ratio, "double")
    judged = pairs.withColumn("near", easy | (F.coalesce(ratio_of(F.when(unsure, F.col("t")), F.when(unsure, F.col("p"))), F.lit(0.0)) >= ratio))
    out = judged.groupBy("meeting_id").agg(F.count("*").alias("texts"), F.countDistinct("t").alias("distinct_texts"), F.count_if("near").alias("near_pairs"))
    few = F.col("texts") < enough
    return out.withColumn("distinct_texts", F.when(few, F.col("texts")).otherwise(F.col("distinct_texts"))).withColumn("near_pairs", F.when(few, 0).otherwise(F.col("near_pairs")))


def segment_windows(segments: DataFrame, window_ms: int = 2500, overlap_ms: int = 400, least_ms: int = 500) -> DataFrame:
    """Overlapping windows over each segment: meeting_id, seq, k, from_ms, to_ms. Segments under least_ms have none; one of a window's
    length or less is one window. Starts are whole multiples of the stride from the segment's start, so no error adds up."""
    stride = max(least_ms, window_ms - overlap_ms)
    start = F.greatest("start_ms", F.lit(0))
    s = segments.select("meeting_id", "seq", start.alias("s"), F.greatest(start, F.col("end_ms")).alias("e")).where(F.col("e") - F.col("s") >= least_ms)
    last = F.greatest(F.lit(0), F.ceil((F.col("e") - F.col("s") - window_ms) / stride))
    w = s.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn("from_ms", F.col("s") + F.col("k") * stride)
    w = w.withColumn("to_ms", F.least(F.col("from_ms") + window_ms, F.col("e"))).where(F.col("to_ms") - F.col("from_ms") >= least_ms)
    return w.select("meeting_id", "seq", "k", "from_ms", "to_ms")


def expand_from_longest(utterances: DataFrame, target_ms: int = 20_000, gap_ms: int = 3000) -> DataFrame:
    """Of each meeting and speaker: the longest utterance (the first of equals), then those after it and then those before it, as long as the
    pause to the next is gap_ms at most and the target length is not reached. Returns the chosen rows with picked (0 the longest)."""
    d = F.col("end_ms") - F.col("start_ms")
    by = W.partitionBy("meeting_id", "speaker")
    rows = utterances.select("meeting_id", "speaker", "seq", "start_ms", "end_ms", d.alias("d"))
    rows = rows.withColumn("anchor", F.first("seq").over(by.orderBy(F.desc("d"), "seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    order = by.orderBy("seq")
    after, before = F.col("seq") > F.col("anchor"), F.col("seq") < F.col("anchor")
    broken_after = F.when(after & (F.col("start_ms") - F.lag("end_ms").over(order) > gap_ms), 1).otherwise(0)
    broken_before = F.when(before & (F.lead("start_ms").over(order) - F.col("end_ms") > gap_ms), 1).otherwise(0)
    rows = rows.withColumns({"ba": broken_after, "bb": broken_before})
    upto, back = order.rowsBetween(W.unboundedPreceding, W.currentRow), by.orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({"ga": F.sum("ba").over(upto), "gb": F.sum("bb").over(back), "ra": F.sum(F.when(F.col("seq") >= F.col("anchor"), F.col("d"))).over(upto)})
    # an utterance after the longest is taken while what is held before it is short of the target
    right = after & (F.col("ga") == 0) & (F.col("ra") - F.col("d") < target_ms)
    rows = rows.withColumn("right", right | (F.col("seq") == F.col("anchor")))
    held = F.sum(F.when(F.col("right"), F.col("d"))).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.withColumn("held", held).withColumn("rb", F.sum(F.when(before, F.col("d"))).over(back))
    left = before & (F.col("gb") == 0) & (F.col("held") + F.col("rb") - F.col("d") < target_ms)
    chosen = rows.where(F.col("right") | left)
    rank = F.row_number().over(by.orderBy(F.when(before, 1).otherwise(0), F.when(before, -F.col("seq")).otherwise(F.col("seq")))) - 1
    return chosen.select("meeting_id", "speaker", "seq", "start_ms", "end_ms", rank.cast("long").alias("picked"))


def transcript_tokens(chars: int) -> int:
    """A rough count of a model's tokens for a transcript."""
    return int(chars * 0.5) + 2048


def recommended_context(tokens: Column) -> Column:
    """The context to ask for: the next multiple of 1024 above, from 4096 to 131072."""
    return F.least(F.lit(131_072), F.greatest(F.lit(4096), (F.floor(tokens / 1024) + 1) * 1024)).cast("long")


def context_fit(transcript: Column, context: int = 32_768) -> Column:
    """struct<tokens, fits, recommended>: does a transcript fit a model's context, and which would do?"""
    tokens = (F.floor(F.length(F.coalesce(transcript, F.lit(""))) / 2) + 2048).cast("long")
    return F.struct(tokens.alias("tokens"), (tokens <= context).alias("fits"), recommended_context(tokens).alias("recommended"))


def max_chunk_tokens(context: int) -> int:
    return max(4096, min(12_000, max(4096, context - 2048)))


CHUNKS = "meeting_id long, seq long, chunk long"


def chunk_utterances(utterances: DataFrame, chunk_ms: int = 900_000, context: int = 32_768) -> DataFrame:
    """meeting_id, seq, chunk: consecutive utterances in chunks that last under chunk_ms and fit the token budget.

    A chunk ends where the next utterance would end chunk_ms or more after the chunk's start, or would exceed the budget. The state starts anew
    at each cut, so rows of a meeting are folded in order: they arrive sorted, meeting after meeting, and are never held whole.
    """
    budget = max_chunk_tokens(context)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        meeting, chunk, began, chars = None, 0, 0, 0
        for rows in batches:
            out = []
            for m, start, end, size in zip(rows.meeting_id, rows.start_ms, rows.end_ms, rows["size"], strict=True):
                if m != meeting:
                    meeting, chunk, began, chars = m, 0, start, 0
                elif (chunk_ms > 0 and end - began >= chunk_ms) or transcript_tokens(chars + 1 + size) > budget:
                    chunk, began, chars = chunk + 1, start, 0
                chars += size + (1 if chars else 0)
                out.append(chunk)
            yield pd.DataFrame({"meeting_id": rows.meeting_id, "seq": rows.seq, "chunk": out})

    said = utterances.where(F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) > 0)
    line = F.length(F.concat(F.lit("[00:00] "), F.coalesce("speaker", F.lit("?")), F.lit(": "), F.col("text")))
    sized = said.select("meeting_id", "seq", "start_ms", "end_ms", line.cast("long").alias("size"))
    return sized.repartition("meeting_id").sortWithinPartitions("meeting_id", "seq").mapInPandas(fold, CHUNKS)


#: Rows of a meeting in one block, where jumps are followed by many tasks.
BLOCK_ROWS = 20_000


def _jumps(start: np.ndarray, end: np.ndarray, size: np.ndarray, chunk_ms: int, limit: int) -> np.ndarray:
    """For each row the first later one that a chunk which begins with it cannot take, or the number of rows. The budget's cut is found by halving on the running
    sums of sizes, the time's by halving on maxima of the ends over windows of 1, 2, 4, ... rows, as ends need not rise."""
    n, rows = len(start), np.arange(len(start))
    upto = np.cumsum(size) + rows
    by_size = np.searchsorted(upto, np.concatenate([[0], np.cumsum(size)[:-1]]) + rows + limit, "left")
    out = np.maximum(by_size, rows + 1)
    if chunk_ms > 0:
        wanted, levels = start + chunk_ms, [np.where(np.isnan(end), -np.inf, end)]
        while 1 << len(levels) <= n:
            last, half = levels[-1], 1 << (len(levels) - 1)
            levels.append(np.maximum(last[:-half], last[half:]))
        at = rows + 1
        for k in range(len(levels) - 1, -1, -1):
            inside = at + (1 << k) <= n
            low = np.zeros(n, bool)
            low[inside] = ~(levels[k][at[inside]] >= wanted[inside])
            at = np.where(low, at + (1 << k), at)
        out = np.minimum(out, at)
    return np.minimum(out, n)


def chunk_by_jumps(utterances: DataFrame, chunk_ms: int = 900_000, context: int = 32_768, block: int = BLOCK_ROWS) -> DataFrame:
    """The same as chunk_utterances, for meetings of any length: no task folds a meeting.

    A meeting's rows are numbered and cut into blocks. As the budget bounds a chunk's rows, where a chunk ends is known from a block and the first rows of
    the next. Each block tells, for each row that a chunk could first begin with in it, where in the next block the chunks from there lead to, and how many they are;
    one task for each meeting follows these jumps from block to block, a few numbers each, and then all blocks number their chunks. Short meetings' blocks are dealt together.
    """
    budget = max_chunk_tokens(context)
    limit = 2 * (budget - 2047)
    reach = limit // 12 + 2  # rows of a chunk at most: a line has eleven characters or more, and its end
    block = max(block, reach)
    said = utterances.where(F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) > 0)
    line = F.length(F.concat(F.lit("[00:00] "), F.coalesce("speaker", F.lit("?")), F.lit(": "), F.col("text")))
    rows = numbered(said.select("meeting_id", "seq", "start_ms", "end_ms", line.cast("long").alias("size")), ["meeting_id", "seq"], "k")
    first = rows.groupBy("meeting_id").agg(F.min("k").alias("k0"))
    rows = rows.join(first, "meeting_id").withColumn("r", F.col("k") - F.col("k0")).withColumn("block", F.floor(F.col("r") / block)).drop("k", "k0")
    # the first rows of a block are read with the one before it too
    also = rows.where((F.col("r") % block < reach) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1)
    dealt = kept(rows.unionByName(also))
    # blocks of short meetings share a group, of as many rows as a long one's block, as a group costs more than a block
    groups = F.lit(max(1, -(-dealt.count() // BLOCK_ROWS)))
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("meeting_id", "block"), groups))

    def ways(rows: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray]]:
        """Of each block of rows, which are in order, the first row's place, the number of its own rows, and where each of its rows leads."""
        meeting, of, r, size = (rows[c].to_numpy() for c in ("meeting_id", "block", "r", "size"))
        start, end = (rows[c].to_numpy(dtype=float) for c in ("start_ms", "end_ms"))
        cuts = np.flatnonzero((meeting[1:] != meeting[:-1]) | (of[1:] != of[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(r)], strict=True):
            yield lo, int((r[lo:hi] < (of[lo] + 1) * block).sum()), _jumps(start[lo:hi], end[lo:hi], size[lo:hi], chunk_ms, limit)

    def told(rows: pd.DataFrame) -> pd.DataFrame:
        rows, at, out = rows.sort_values(["meeting_id", "block", "r"]), [], []
        for lo, own, to in ways(rows):
            leads, count = np.zeros(own, np.int64), np.zeros(own, np.int64)
            for i in range(own - 1, -1, -1):
                j = int(to[i])
                leads[i], count[i] = (j - own, 1) if j >= own else (leads[j], count[j] + 1)
            at.append(lo)
            out.append((leads[:reach].tolist(), count[:reach].tolist()))
        return pd.DataFrame({"meeting_id": rows.meeting_id.to_numpy()[at], "block": rows.block.to_numpy()[at], "leads": [x for x, _ in out], "count": [x for _, x in out]})

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        meeting, at, base, out = None, 0, 0, []
        for r in rows.sort_values(["meeting_id", "block"]).itertuples(index=False):
            if r.meeting_id != meeting:
                meeting, at, base = r.meeting_id, 0, 0
            out.append((r.meeting_id, r.block, at, base))
            if at < len(r.leads):  # else a chunk ends with the meeting
                at, base = int(r.leads[at]), base + int(r.count[at])
        return pd.DataFrame(out, columns=["meeting_id", "block", "entry", "base"])

    entries = dealt.groupBy("group").applyInPandas(told, "meeting_id long, block long, leads array<long>, count array<long>")
    entries = entries.groupBy(F.pmod(F.xxhash64("meeting_id"), groups)).applyInPandas(follow, "meeting_id long, block long, entry long, base long")

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["meeting_id", "block", "r"])
        entry, base, mine, chunk = rows.entry.to_numpy(), rows.base.to_numpy(), [], []
        for lo, own, to in ways(rows):
            begins, i = np.zeros(own, np.int64), int(entry[lo])
            while i < own:
                begins[i] = 1
                i = int(to[i])
            mine.append(np.arange(lo, lo + own))
            chunk.append(base[lo] - 1 + np.cumsum(begins))
        at = np.concatenate(mine)
        return pd.DataFrame({"meeting_id": rows.meeting_id.to_numpy()[at], "seq": rows.seq.to_numpy()[at], "chunk": np.concatenate(chunk)})

    return dealt.join(entries, ["meeting_id", "block"]).groupBy("group").applyInPandas(number, CHUNKS)
