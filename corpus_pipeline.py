"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import decontaminate, mixing, ngram_join, quality, token_files
from parley.llm._store import materialise, sent
from parley.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(docs: DataFrame) -> DataFrame:
    """docs with __row: for each row a number of its own, as ids may be null or repeated. It is the same whenever docs is read: the place of
    the row's file among all, and the row's in it. What is not simply read from files is written first."""
    spark = docs.sparkSession
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = materialise(docs, "pipeline-rows")
    placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    names = sorted(r[0] for r in placed.select("__file").distinct().collect())  # one for each file
    files = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "__file string, __place long")
    return placed.join(F.broadcast(files), "__file").select(*docs.columns, F.expr("shiftleft(__place, 40) + __at").alias("__row"))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows but those whose __row is in gone."""
    return rows.join(sent(materialise(gone.select("__row"), "pipeline-rows-gone")), "__row", "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.judge(docs, prefix="__quality_").where("__quality_kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: of the smallest id (a null counts as the smallest), of those that share it the first."""
    rows = _rows(docs)
    got = ngram_join.near_duplicates(rows.select("__row", "text"), "__row").select("__row", "component_id")
    moved = materialise(got.where("__row <> component_id"), "pipeline-moved")
    members = moved.unionByName(moved.select(F.col("component_id").alias("__row"), "component_id").distinct())
    ids = rows.select("__row", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(ngram_join.NULL_ID)).alias("__id"))
    members = materialise(ids.join(sent(materialise(members, "pipeline-members")), "__row"), "pipeline-member-ids")
    stay = members.groupBy("component_id").agg(F.min(F.struct("__id", "__row"))["__row"].alias("__row"))
    return _without(rows, members.join(stay.select("__row"), "__row", "left_anti")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, each row by its own text."""
    rows = _rows(docs)
    got = decontaminate.contamination_report(rows.select("__row", "text"), table(spark, sf_dir, "benchmark"), id_col="__row")
    return _without(rows, got.where("contaminated").select(F.col("doc_id").alias("__row"))).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stays as often as the mix takes it: not at all, once, or up to three times as rows of its own."""
    rows = _rows(docs)
    taken = mixing.mix(rows.select("__row", "doc_id", "text", "source"), row_col="__row").where("taken > 0")
    times = taken.select("__row", F.expr("cast(taken div size as int)").alias("__times"))
    rows = rows.join(sent(materialise(times, "pipeline-times")), "__row")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' document index: doc_id, start, n_tokens, ids_crc32. Repeated documents are repeated in the files."""
    return token_files.token_index(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Expectation-maximisation and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL: str | None = None
