"""Line dedup with levelled sorted runs of line hashes. DataFrame functions only.

A run is a table of (key, doc_id), each pair once, bucketed and sorted: the same buckets for every run and every batch, so that
a batch is compared with a run bucket by bucket, and what is stored is shuffled only when its level is merged. A batch of documents first looks its
pairs up in the runs by a merge join (left anti): those that no run has are new, become a run of level 0 and are counted; a document that is delivered
again, whole or in part, adds nothing. Once a level holds FANOUT runs they are merged into one of the next, so
that a store of n batches has about FANOUT * log(n) runs and each row is rewritten log(n) times.

Batches may arrive in any order. As pairs are dealt by both columns, a line that is in very many documents lies in all buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm._store import materialise, new_path, own_shuffles_dropped, remove

SPACES = "\x20\t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS = 20, 3
FANOUT = 4
#: Into how many batches a whole table is dealt; a feed calls LineRuns.add once for each delivery instead.
BATCHES = 6


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased. ASCII lines take lower(), which does the same there, faster."""
    bare = F.trim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def key_hash(line: Column, min_chars: int = MIN_CHARS) -> Column:
    """The 128-bit hash of a line's key; null for keys under min_chars code points."""
    return F.when(F.length(F.trim(line, F.lit(SPACES))) >= min_chars, F.unhex(F.md5(line_key(line).cast("binary"))))


class LineRuns:
    """The store: runs by level."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, list[tuple[str, str]]] = {}

    def _stored(self, rows: DataFrame, name: str, dealt: bool) -> tuple[str, str]:
        """rows as a table bucketed by both columns: (table, path). dealt: they already lie in the store's buckets, one in each task."""
        path, table = new_path(self.spark, name), f"parley_{name.replace('-', '_')}_{uuid.uuid4().hex}"
        rows = rows if dealt else rows.repartition(self.buckets, "key", "doc_id")
        with own_shuffles_dropped(self.spark):
            rows.write.bucketBy(self.buckets, "key", "doc_id").sortBy("key", "doc_id").option("path", path).saveAsTable(table)
        return table, path

    def _forget(self, *stored: tuple[str, str]) -> None:
        for table, path in stored:
            self.spark.sql(f"DROP TABLE {table}")
            remove(self.spark, path)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(table) for stored in self.levels.values() for table, _ in stored]

    def close(self) -> None:
        """Drops all runs."""
        self._forget(*(x for stored in self.levels.values() for x in stored))
        self.levels = {}

    def new_pairs(self, batch: DataFrame) -> DataFrame:
        """Rows of batch (key, doc_id) that no run has yet."""
        for run in self.runs():
            batch = batch.join(run.hint("merge"), ["key", "doc_id"], "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """batch: key, doc_id; one row for each line, or more. What the store does not have is added."""
        batch = batch.select("key", "doc_id").distinct()
        if self.levels:
            held = self._stored(batch, "line-batch", False)
            run = self._stored(self.new_pairs(self.spark.table(held[0])), "line-run-0", True)
            self._forget(held)
        else:
            run = self._stored(batch, "line-run-0", False)
        self.levels.setdefault(0, []).append(run)
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            old = self.levels[level]
            self.levels.setdefault(level + 1, []).append(self._stored(self.merged(old), f"line-run-{level + 1}", False))
            self.levels[level] = []
            self._forget(*old)
            level += 1

    def merged(self, stored: list[tuple[str, str]]) -> DataFrame:
        """All rows of some runs, which share none. The runs are read as plain files: a union of bucketed tables is taken for bucketed (Spark 4.1) though its
        scans are not."""
        rows = None
        for _, path in stored:
            run = self.spark.read.schema("key binary, doc_id bigint").parquet(path)
            rows = run if rows is None else rows.unionByName(run)
        return rows

    def keys(self) -> DataFrame | None:
        """key, n_docs, keeper (the largest document) over all batches."""
        stored = [x for stored in self.levels.values() for x in stored]
        return self.merged(stored).groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")) if stored else None


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """One row per row of docs: id_col, n_lines, n_dropped, text (the lines that stay, joined by \\n).

    A null or empty text is one empty line, which stays. A key counts once per document, also where documents repeat as rows;
    those rows all keep its lines if theirs is the largest id. A null id counts as the least of all. Copies of a
    line within the keeping document all stay.
    """
    spark = docs.sparkSession
    ident = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = F.split(text, "\n", -1)
    hashes = F.transform(split, lambda x: key_hash(x, min_chars))
    places = F.filter(F.transform(hashes, lambda h, i: F.struct(h.alias("key"), i.alias("at"))), lambda x: x["key"].isNotNull())
    # rows that share an id are told apart by their text
    lines = materialise(docs.select(ident.alias("doc_id"), F.xxhash64(text).alias("of"), F.explode(places).alias("x")).select("doc_id", "of", "x.key", "x.at"), "lines")
    # batches by ranges of id
    bounds = sorted(set(lines.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    edges = [None, *(int(b) for b in bounds), None]
    store = LineRuns(spark, fanout)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        batch = lines.select("key", "doc_id")
        batch = batch if lo is None else batch.where(F.col("doc_id") > lo)
        store.add(batch if hi is None else batch.where(F.col("doc_id") <= hi))
    # a table of its own, so that Spark can split the join where one line is in very many documents
    over = materialise(store.keys().where(F.col("n_docs") >= min_docs).select("key", "keeper"), "lines-over")
    store.close()
    drop = lines.join(over, "key").where(F.col("doc_id") < F.col("keeper")).groupBy("doc_id", "of").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    out = docs.select(F.col(id_col).alias("__id"), ident.alias("doc_id"), F.xxhash64(text).alias("of"), text.alias("__text")).join(drop, ["doc_id", "of"], "left")
    # the stretches between the lines that go; the arrays of one hold what the lambda reads, so that it is made once
    edge = lambda g, i: F.when(i < 0, -1).otherwise(F.get(g, i))
    stretch = lambda x, i: F.slice(x["lines"], edge(x["gone"], i - 1) + 2, F.coalesce(F.get(x["gone"], i), F.size(x["lines"])) - edge(x["gone"], i - 1) - 1)
    pieces = F.transform(F.array(F.struct(F.split("__text", "\n", -1).alias("lines"), F.col("gone").alias("gone"))), lambda x: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["gone"])), lambda i: stretch(x, i))), "\n"))
    kept = F.when(F.col("gone").isNull(), F.col("__text")).otherwise(F.element_at(pieces, 1))
    n_lines = F.octet_length("__text") - F.octet_length(F.replace(F.col("__text"), F.lit("\n"), F.lit(""))) + 1
    return out.select(F.col("__id").alias(id_col), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size(F.col("gone")), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("text"))
