"""Where operators put intermediate tables: under spark.checkpoint.dir, which driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writing: dict[str, list] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. On one machine without a setting: a temporary folder; on a cluster that raises."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.gettempdir()}/parley-shared"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/parley/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def own_shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While a table is written: Spark drops the shuffle files of a statement at its end. The session's setting comes back with the last writer that
    runs at the same time; until then it holds for other statements of the session too, whose results it does not change."""
    key = spark._jsparkSession.sessionUUID()
    with _lock:
        writers = _writing.setdefault(key, [0, spark.conf.get(CLEANUP, "false")])
        writers[0] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            writers[0] -= 1
            if not writers[0]:
                spark.conf.set(CLEANUP, _writing.pop(key)[1])


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors. Nothing reads its shuffles again."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with own_shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Drop a table that is no longer read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(df: DataFrame) -> None:
    """Drop the files behind a materialised frame."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Drop all intermediate tables and token files that this library left in the shared folder. Frames that read them end with it."""
    remove(spark, f"{shared_dir(spark)}/parley")


#: Rows up to which a narrow table goes to every task.
BROADCAST_ROWS = 500_000


def sent(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table, to be sent to every task if a count shows that it is small; else it is shuffled like any other."""
    return F.broadcast(ids) if ids.limit(rows + 1).count() <= rows else ids
