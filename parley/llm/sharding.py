"""Sharding by extendible hashing. DataFrame functions only.

The directory is indexed by the prefixes of the key's hash, at first of START_BITS bits; only a bucket over the byte limit is split, on one
bit more, until each fits. Rows that no further bit of the hash tells apart (one key, or one row over the limit)
go on splitting by a hash of their place in the table, and a single row over the limit is a shard of its own.

The rows themselves are not dealt level by level: bytes are summed by a prefix that is some bits longer than the table's size asks for, the buckets
are split on these sums, and each row looks its shard up in the directory once. Only rows of buckets that are still over the limit there, as
a hot key's are, go through another such step, on more bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm._store import materialise, sent

START_BITS = 2
#: Bits of the key's hash; those after it come from the row.
KEY_BITS, ALL_BITS = 48, 96
LIMIT = 16 << 20
#: Bits that sums are taken by beyond those that evenly filled shards would need, and bits of a further step.
SLACK, STEP = 4, 16


def hash_number(key: Column) -> Column:
    """The first 48 bits of the MD5 of key's string form, as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("bigint")


def _node(depth: Column, key: Column, place: Column) -> list[Column]:
    """The node of the given depth that a row's 48 bits of key and 48 bits of place lie in, as two numbers."""
    short = depth <= KEY_BITS
    cut = lambda x, n: F.floor(x / F.pow(F.lit(2.0), n)).cast("bigint")  # noqa: E731  exact: 48 bits fit a double
    return [F.when(short, cut(key, KEY_BITS - depth)).otherwise(key).alias("a"), F.when(short, F.lit(0)).otherwise(cut(place, ALL_BITS - depth)).cast("bigint").alias("b")]


def _bits(depth: Column, a: Column, b: Column) -> Column:
    padded = lambda x, n: F.lpad(F.bin(x), n, "0")
    return F.when(depth <= KEY_BITS, padded(a, depth)).otherwise(F.concat(padded(a, F.lit(KEY_BITS)), padded(b, depth - KEY_BITS)))


def _steps(rows: DataFrame, limit: int, start_bits: int):
    """The steps: (rows still to be placed, with their leaf's a and b; leaf a, b -> shard, depth, shard_bytes, shard_rows; last bit)."""
    whole = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).first()["bytes"]
    lo, left = start_bits, rows
    hi = min(KEY_BITS, max(lo, math.ceil(math.log2(max(1, whole / limit))) + SLACK))
    while True:
        placed = left.select("*", *_node(F.lit(hi), F.col("key"), F.col("spot")))
        leaves = materialise(placed.groupBy("a", "b").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")), "shards-leaves")
        # every leaf lies in one node of each depth; in the coordinates of whole hashes a leaf is its first place
        key, spot = (F.col("a") * 2 ** (KEY_BITS - hi), F.lit(0)) if hi <= KEY_BITS else (F.col("a"), F.col("b") * 2 ** (ALL_BITS - hi))
        up = leaves.select("a", "b", "bytes", "n", key.cast("bigint").alias("key"), F.lit(spot).cast("bigint").alias("spot"), F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("depth"))
        x, y = _node(F.col("depth"), F.col("key"), F.col("spot"))
        up = up.select("depth", x.alias("na"), y.alias("nb"), F.col("a").alias("leaf_a"), F.col("b").alias("leaf_b"), "bytes", "n")
        nodes = up.groupBy("depth", "na", "nb").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fit = materialise(nodes.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == ALL_BITS)), "shards-fit")
        # what fits is not split: of the nodes that fit on a leaf's way down, the first is its shard
        met = up.join(sent(fit), ["depth", "na", "nb"]).groupBy("leaf_a", "leaf_b").agg(F.min(F.struct("depth", "na", "nb", "shard_bytes", "shard_rows")).alias("s"))
        found = met.select("leaf_a", "leaf_b", _bits(F.col("s.depth"), F.col("s.na"), F.col("s.nb")).alias("shard"), F.col("s.depth").cast("long").alias("depth"), "s.shard_bytes", "s.shard_rows")
        found = materialise(found, "shards-directory")
        yield placed, found
        over = materialise(leaves.join(sent(found.select(F.col("leaf_a").alias("a"), F.col("leaf_b").alias("b"))), ["a", "b"], "left_anti").select("a", "b"), "shards-over")
        if hi == ALL_BITS or over.isEmpty():
            return
        left = placed.join(sent(over), ["a", "b"], "left_semi").drop("a", "b")
        lo, hi = hi + 1, KEY_BITS if hi < KEY_BITS <= hi + STEP else min(ALL_BITS, hi + STEP)


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, start_bits: int = START_BITS, carry: bool = False) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, shard (its bits), depth, shard_bytes, shard_rows.

    A null text has 0 bytes; a null id is hashed as an empty string. Rows that share an id share a shard unless that shard would
    pass the limit. No shard of more than one row passes it, up to ALL_BITS bits. With carry, docs has the row's own place as __place, which is returned too.
    """
    place = F.col("__place") if carry else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), hash_number(F.col(id_col)).alias("key"), place.alias("place"))
    rows = materialise(rows.withColumn("spot", hash_number(F.col("place"))), "shards-rows")
    own = [F.col("place").alias("__place")] if carry else []
    done = None
    for placed, found in _steps(rows, limit, start_bits):
        part = placed.join(sent(found).withColumnsRenamed({"leaf_a": "a", "leaf_b": "b"}), ["a", "b"]).select(*own, F.col("id").alias(id_col), "n_bytes", "shard", "depth", "shard_bytes", "shard_rows")
        done = part if done is None else done.unionByName(part)
    return done


def directory(placed: DataFrame) -> DataFrame:
    """The directory behind shards(): shard, depth, shard_bytes, shard_rows, one row for each."""
    return placed.select("shard", "depth", "shard_bytes", "shard_rows").distinct()


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", **options) -> DataFrame:
    """Write docs under path, one folder and file for each shard (named b and its bits; each row goes to its own, a shard is one task's and within the limit), and return the directory, which
    is written to path too, as _directory (a name that readers of the folder pass over)."""
    # written once, so that a row has the same place whenever it is read
    rows = materialise(docs.withColumn("__place", F.monotonically_increasing_id()), "shards-docs")
    got = materialise(shards(rows, id_col, carry=True, **options), "shards-done")
    where = got.select("__place", F.concat(F.lit("b"), "shard").alias("shard"))
    rows.join(where, "__place").drop("__place").repartition("shard").write.partitionBy("shard").parquet(path)
    directory(got).coalesce(1).write.parquet(f"{path}/_directory")
    return docs.sparkSession.read.parquet(f"{path}/_directory")
