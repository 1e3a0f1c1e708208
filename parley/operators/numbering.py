"""Dense numbers over all rows of a table, without a task that sees them all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _checkpoint_dir(spark: SparkSession) -> str:
    if not spark.sparkContext.getCheckpointDir():
        at, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not at and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(at or f"{tempfile.gettempdir()}/parley-checkpoints")
    return spark.sparkContext.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df, written once to the checkpoint folder that the session names: what is computed from it agrees, also after executors are lost. On one machine
    without a setting, a temporary folder; on a cluster that raises.

    A checkpoint carries on the plan's estimate of its size, which a join multiplies; what is made again from itself in rounds needs stored."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession) -> str:
    return f"{_checkpoint_dir(spark)}/parley-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, written once as a table in the checkpoint folder and read back: its size is that of its files, however it was made."""
    path = path or new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Drop the files of stored tables that are no longer read."""
    for df in tables:
        for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(rows: DataFrame, order: list[str | Column], to: str = "number", after: Column | None = None, parts: int | None = None) -> DataFrame:
    """rows with the column to: 1, 2, ... in ascending order, nulls first, counted on from after (one value for all rows) if it is given.

    Rows are dealt by ranges of the order; a range's first number is the sum of the counts of the ranges before it, of which there is one number for each
    range. Rows alike in the order are numbered one after another, in any order.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = kept(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # one row for each range stands in this window
    before = counts.select("__part", (F.sum("__n").over(W.partitionBy(F.lit(0)).orderBy("__part")) - F.col("__n")).alias("__before"))
    number = F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    got = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return got.select(*(c for c in rows.columns if c != to), (number if after is None else number + after).cast("long").alias(to))
