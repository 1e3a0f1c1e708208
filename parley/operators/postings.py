"""A stored posting table: for each run of three characters the rows, columns and places that hold it; phrases are looked up and verified in it alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id long, field string, gram string, places array<int>"
BUCKETS = 64
#: Characters of text whose postings one task makes or sorts (some 70 bytes for each), and places of grams that one task puts together.
TASK_CHARS, TASK_PLACES = 8_000_000, 2_000_000


def postings(rows: DataFrame, columns: list[str]) -> DataFrame:
    """id, field, gram, places: each gram of a row's columns, lower-cased, once, with the places (from 0, in characters) where it begins. A null or
    short text has none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, name in enumerate(columns):
                for i, text in zip(batch.column(0).to_pylist(), batch.column(k + 1).to_pylist(), strict=True):
                    if text is None or len(text) < 3:
                        continue
                    u = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
                    g = (u[:-2] << np.uint64(42)) | (u[1:-1] << np.uint64(21)) | u[2:]
                    order = np.argsort(g, kind="stable")
                    first = np.flatnonzero(np.diff(g[order], prepend=~g[order[:1]]))
                    grams = [text[p : p + 3] for p in order[first].tolist()]
                    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(order, pa.int32()))
                    n = len(grams)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array([name] * n), pa.array(grams), places], names=["id", "field", "gram", "places"])

    # the engine's own lower case, which the SQL of searches uses too
    return rows.select(F.col("id").cast("long"), *(F.lower(c).alias(c) for c in columns)).mapInArrow(cut, SCHEMA)


def store(made: DataFrame, table: str, buckets: int = BUCKETS, tasks: int = BUCKETS) -> None:
    """Adds postings to the table, made if it is not there: bucketed by gram and sorted, so that a look-up reads the buckets of its grams alone. A batch of rows is
    added once; later batches are new files of the same buckets. With more tasks than buckets a bucket is several tasks' and files, by the row's id."""
    parts = -(-tasks // buckets)
    if parts > 1:
        # the bucket that bucketBy puts a gram into
        dealt = made.repartitionById(buckets * parts, (F.pmod(F.hash("gram"), F.lit(buckets)) * parts + F.pmod(F.xxhash64("id"), F.lit(parts))).cast("int"))
    else:
        dealt = made.repartition(buckets, "gram")
    dealt.write.mode("append").bucketBy(buckets, "gram").sortBy("gram", "id").saveAsTable(table)


def add(rows: DataFrame, columns: list[str], table: str, buckets: int = BUCKETS, task_chars: int = TASK_CHARS) -> None:
    """Stores the postings of rows, in as many tasks as the texts' length asks for, so that what a task holds does not grow with them."""
    length = sum((F.coalesce(F.length(c), F.lit(0)) for c in columns), F.lit(0))
    tasks = -(-(rows.agg(F.sum(length).alias("n")).first()["n"] or 0) // task_chars)
    if tasks > rows.sparkSession.sparkContext.defaultParallelism:
        rows = rows.repartition(tasks, "id")
    store(postings(rows, columns), table, buckets, tasks)


def phrase_hits(spark: SparkSession, table: str, phrase: str, task_places: int = TASK_PLACES) -> DataFrame:
    """id, hits: the rows that hold the phrase, whatever its case, and how often over all columns, overlapping ones too. Verified by places: the phrase stands where all its
    grams stand at their distances; no text is read. A phrase of under three characters has no hits.

    A bucket is read by one task, which holds nothing of it; rows are put together by id in as many tasks as their places ask for."""
    low = spark.range(1).select(F.lower(F.lit(phrase)).alias("x")).first()["x"]
    at: dict[str, list[int]] = {}
    for i in range(len(low) - 2):
        at.setdefault(low[i : i + 3], []).append(i)
    if not at:
        return spark.createDataFrame([], "id long, hits long")
    found = spark.table(table).where(F.col("gram").isin(sorted(at)))
    shift = F.create_map(*(x for g, of in at.items() for x in (F.lit(g), F.array(*(F.lit(o) for o in of)))))
    places = found.agg(F.sum(F.size("places") * F.size(F.element_at(shift, F.col("gram")))).alias("n")).first()["n"] or 0
    found = found.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-places // task_places)), "id", "field")
    # where the phrase would begin, by each place of each of its grams
    every = found.select("id", "field", "places", F.explode(F.element_at(shift, F.col("gram"))).alias("o")).select("id", "field", "o", F.explode("places").alias("p")).select("id", "field", (F.col("p") - F.col("o")).alias("start"))
    whole = every.groupBy("id", "field", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(low) - 2)
    return whole.groupBy("id").agg(F.count("*").alias("hits"))
