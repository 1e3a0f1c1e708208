"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

The documents of a source, in an order shuffled by a hash of the id, are a queue that may be served up to EPOCHS times. An
entry's virtual finish time is the words its source has had served by then, divided by the source's weight. All queues
are served in ascending finish time until the budget, the words of all documents, is used up. A source that runs out leaves its
share to the others by weight, which is what capping a source's target and resharing the excess gives.

Running sums are taken in two steps, so that no source, however large, is one task: hash ranges first, then the rows within
each range. Of the global order only the finish times' histogram and the one narrow range that the budget ends in are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm._store import materialise

EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Rows of a source in one hash range, about.
RANGE_ROWS = 20_000
#: Ranges of finish times that the budget's end is sought in.
BINS = 1 << 14


def word_count(text: Column) -> Column:
    """Number of [\\x20\\x09-\\x0D]-separated words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sizes: src, source_size, one row per source. Adds w, target. Weights repeat over the sources by code point, null last."""
    # one row for each source stands in these windows, never a document
    order = W.orderBy(F.col("src").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (k + 1).cast("int"))
    out = sizes.withColumn("w", w).withColumn("cap", (F.lit(epochs) * F.col("source_size")).cast("double"))
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("src").asc_nulls_last())
    before, whole = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(whole).cast("double")
    # the level that this source and all with a higher cap per weight would get, were the lower ones at their caps
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    out = out.withColumn("level", level)
    # the first source that its level does not bring over its cap sets the level for all after it; later levels are lower
    out = out.withColumn("cut", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(whole))
    return out.select("src", "source_size", "w", F.least("cap", F.coalesce(F.col("cut") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, row_col: str | None = None) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, taken (words that the mix takes, repeats counted).

    A null text has size 0 and is never taken; a null source is a source, the last; a null id is shuffled as an empty one. Rows
    that share an id are queued apart, equal ones in any order, or by row_col if it is given: a number of each row's own, then returned too. Nothing is random: a rerun gives the same rows. No words at
    all: every target is 0.
    """
    spark = docs.sparkSession
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    row = [F.col(row_col).alias("row")] if row_col else []
    own = ["row"] if row_col else []
    rows = materialise(docs.select(*row, F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), word_count(F.col(text_col)).alias("size"), key.alias("key")), "mix-sizes")
    n = rows.count()
    targets = materialise(source_targets(rows.groupBy("src").agg(F.sum("size").alias("source_size")), weights, epochs), "mix-targets").withColumnRenamed("src", "src_t")
    same = F.col("src").eqNullSafe(F.col("src_t"))
    # hash ranges within a source: their sums are few, one for about RANGE_ROWS rows
    digits = max(1, len(f"{n // RANGE_ROWS:x}"))
    rows = rows.withColumn("rng", F.substring("key", 1, digits))
    sums = rows.groupBy("src", "rng").agg(F.sum("size").alias("rng_size"))
    before = W.partitionBy("src").orderBy("rng").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("rng_size").over(before), F.lit(0))).join(targets, same).select(F.col("src").alias("src_r"), F.col("rng").alias("rng_r"), "base", "source_size", "w", "target")
    within = W.partitionBy("src", "rng").orderBy("key", "id", "size", *own).rowsBetween(W.unboundedPreceding, W.currentRow)
    queued = rows.withColumn("upto", F.sum("size").over(within)).join(sums, F.col("src").eqNullSafe(F.col("src_r")) & (F.col("rng") == F.col("rng_r")))
    queued = materialise(queued.select(*own, "id", "src", "size", "key", (F.col("upto") + F.col("base")).alias("upto"), "source_size", "w", "target"), "mix-queue")
    finish = lambda e: (F.lit(e) * F.col("source_size") + F.col("upto")).cast("double") / F.col("w")
    entries = F.explode(F.array(*(F.struct(F.lit(e).alias("epoch"), finish(e).alias("finish")) for e in range(epochs))))
    served = queued.where("size > 0").select("id", "src", "size", "key", entries.alias("e")).select("id", "src", "size", "key", "e.epoch", "e.finish")
    ends = targets.agg(F.sum("source_size").alias("budget"), F.max(F.lit(float(epochs)) * F.col("source_size") / F.col("w")).alias("last")).collect()[0]
    budget, last = ends["budget"] or 0, ends["last"] or 0.0
    # how far the budget reaches: first the bin that it ends in, then the entries of that bin one by one
    bin_of = F.least(F.floor(F.col("finish") / F.lit(last / BINS if last else 1.0)), F.lit(BINS - 1))
    bins = served.groupBy(bin_of.alias("bin")).agg(F.sum("size").alias("words"))
    upto = bins.withColumn("upto", F.sum("words").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)))  # BINS rows at most
    cut = upto.where(F.col("upto") > budget).agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("c")).collect()[0]["c"]
    if cut is None:  # all entries fit
        taken = queued.select("*", F.when(F.col("size") > 0, F.lit(epochs)).otherwise(0).alias("times"))
    else:
        # the range that the budget ends in is sorted globally in ranges of its own, and summed in two steps again
        edge = served.where(bin_of == cut["bin"]).withColumn("sub", F.floor((F.col("finish") - cut["bin"] * (last / BINS)) / (last / BINS / BINS)))
        sub = edge.groupBy("sub").agg(F.sum("size").alias("words")).withColumn("base", F.coalesce(F.sum("words").over(W.orderBy("sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.lit(cut["before"])).select(F.col("sub").alias("sub_s"), "base")
        run = F.sum("size").over(W.partitionBy("sub").orderBy("finish", "key", "src", "epoch", "id").rowsBetween(W.unboundedPreceding, W.currentRow))
        first_out = edge.withColumn("run", run).join(sub, F.col("sub") == F.col("sub_s")).where(F.col("run") + F.col("base") > budget).agg(F.min(F.struct("finish", "key", "src", "epoch")).alias("c")).collect()[0]["c"]
        gone = F.struct(F.lit(first_out["finish"]).alias("finish"), F.lit(first_out["key"]).alias("key"), F.lit(first_out["src"]).cast("string").alias("src"), F.lit(first_out["epoch"]).alias("epoch"))
        fits = [(F.struct(finish(e).alias("finish"), "key", "src", F.lit(e).alias("epoch")) < gone).cast("int") for e in range(epochs)]
        times = fits[0]
        for f in fits[1:]:
            times = times + f
        taken = queued.select("*", F.when(F.col("size") > 0, times).otherwise(0).alias("times"))
    return taken.select(*(F.col(c).alias(row_col) for c in own), F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
