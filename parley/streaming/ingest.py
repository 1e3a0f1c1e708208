"""Incremental ingestion: new files once each, and a sink that repeats do not harm."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.operators.sync import dedupe_by_key
from parley.sources.tables import audio_glob


def audio_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a folder's audio files as they are first seen: path, modificationTime, length. Each comes once, also one that is still being
    written or empty then; where files are not put in place by renaming, take drain_complete."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", audio_glob()).schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("path", "modificationTime", "length")


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands all that is there now to each(batch, number) and ends. The checkpoint remembers the files, also over restarts."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path, or an empty one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def drain_complete(spark: SparkSession, folder: str, state: str, each: Callable[[DataFrame, int], None], stable_s: int = 0) -> int:
    """Hands the folder's audio files to each(batch, number), each file once: those that hold something and were last changed stable_s ago or more.

    Each call lists the folder and compares it with what was handed on before, so a file that was young, empty or half written at one call is
    taken by a later one (a stream's source takes a file when it first sees it, and never again). A run is entered in the table under state once
    each() has returned: a call that broke off is repeated under the same number. Returns how many files with content still wait.
    """
    handed = _table(spark, f"{state}/handed", "path string, run long")
    run = (handed.agg(F.max("run").alias("r")).first()["r"] or 0) + 1
    now = spark.read.format("binaryFile").option("pathGlobFilter", audio_glob()).load(folder).select("path", "modificationTime", "length").where("length > 0")
    ripe = F.col("modificationTime") <= F.current_timestamp() - F.expr(f"INTERVAL {int(stable_s)} SECONDS")
    looked_at = now.join(handed, "path", "left_anti").withColumn("ripe", ripe)
    looked_at.write.mode("overwrite").parquet(f"{state}/runs/{run}")  # what is handed on and what is entered are the same rows
    looked_at = spark.read.parquet(f"{state}/runs/{run}")
    batch = looked_at.where("ripe").drop("ripe")
    if not batch.isEmpty():
        each(batch, run)
        batch.select("path").withColumn("run", F.lit(run).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{state}/handed")
    return looked_at.where("not ripe").count()


def keyed_sink(path: str, key: str = "key", order: str = "seq", send: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends rows whose key is new to the table at path, one partition for each batch, and sends them on.

    A batch that is run again overwrites its own partition and compares with the other ones only, so it writes the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kind = batch.select(key).dtypes[0][1]
        # of the history only the batch's own keys are looked at
        seen = _table(spark, path, f"{key} {kind}, batch long").where(F.col("batch") != number).join(F.broadcast(batch.select(key).distinct()), key, "left_semi")
        new = dedupe_by_key(batch, seen, key, order).withColumn("batch", F.lit(number))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        if send:
            send(spark.read.parquet(path).where(F.col("batch") == number))

    return write


#: Verbs of a remote archive. Those that make or drop something are tried once, as a lost reply does not tell whether they took effect.
VERBS = {"create_post": 0, "create_comment": 0, "delete_post": 0, "cleanup": 0, "update_post": 2, "update_comment": 2, "list_comments": 2}
ACTIONS = "id long, verb string, payload string"
REPLIES = "id long, ok boolean, attempts int, reply string"


def perform(actions: DataFrame, connect: Callable[[], Callable[[str, dict], dict]], retries: dict[str, int] | None = None, backoff_s: float = 3.0) -> DataFrame:
    """Carries out actions (id, verb, payload: JSON) on a remote archive: id, ok, attempts, reply (JSON, or the last error).

    connect() is called once for each task and gives a client(verb, payload) that returns a reply or raises. A verb may be tried again as often as VERBS (or
    retries) has it, after backoff_s, then twice that, and so on; an unknown verb is an error of its own. Write the result once (a second
    evaluation performs the actions again); keys in the payloads make repeated creations harmless.
    """
    allowed = {**VERBS, **(retries or {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for rows in batches:
            out = []
            for i, verb, payload in zip(rows.id, rows.verb, rows.payload, strict=True):
                ok, reply, tries = False, f"unknown verb {verb}", 0
                while verb in allowed and not ok and tries <= allowed[verb]:
                    if tries:
                        time.sleep(backoff_s * tries)
                    tries += 1
                    try:
                        client = client or connect()
                        ok, reply = True, json.dumps(client(verb, json.loads(payload or "{}")), ensure_ascii=False, sort_keys=True)
                    except Exception as e:  # noqa: BLE001  whatever a client raises is its reply
                        reply = str(e)
                out.append((i, ok, tries, reply))
            yield pd.DataFrame(out, columns=["id", "ok", "attempts", "reply"])

    return actions.select("id", "verb", "payload").mapInPandas(run, REPLIES)
