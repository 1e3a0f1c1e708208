"""Stages and shards on rows that share ids, and the names that the driver looks for."""

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from parley.llm import sharding
from tests.conftest import SF


def test_all_operators_are_registered():
    queries = __spark_entry__.queries()
    assert sorted(n.split("_")[0] for n in queries if n.startswith("op") and n[2].isdigit()) == sorted(f"op{i}" for i in range(1, 14)) and "pipeline" in queries


def test_pipeline_judges_rows_not_ids(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len((r.text or "").split()) >= 20)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    plain = lambda tag: " ".join(f"{tag}{i}" for i in range(40))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in [(None, item), (None, plain("b")), (7, item), (7, plain("c")), (8, plain("d"))]], schema)
    left = corpus_pipeline.decontamination(spark, docs, SF).collect()
    assert sorted(r.text for r in left) == [plain("b"), plain("c"), plain("d")]
    # 3 has a near copy under 1, but the other text under 3 has none; exact copies share 5, and null ids
    rows = [(3, plain("x")), (3, plain("y")), (1, plain("x")), (5, plain("z")), (5, plain("z")), (None, plain("n")), (None, plain("n")), (None, plain("m")), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], schema)
    left = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    want = [(1, plain("x")), (3, plain("y")), (5, plain("z")), (None, plain("n")), (None, plain("m")), (4, None), (4, None)]
    assert sorted(((r.doc_id, r.text) for r in left), key=repr) == sorted(want, key=repr)


def test_mix_of_rows_that_share_an_id(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None if i % 3 else 1, " ".join([f"w{i}"] * 10), "en", "ab"[i % 4 == 0], i) for i in range(80)]
    out = [r.n_chars for r in corpus_pipeline.source_mix(spark, spark.createDataFrame(rows, schema).repartition(3), SF).collect()]
    assert 80 - 2 <= len(out) <= 80  # as many words as there are, but for what no longer fits


def test_written_shards_of_a_hot_key(spark, tmp_path):
    docs = spark.createDataFrame([(None if i % 3 else 7, "x" * 100) for i in range(60)], "doc_id long, text string")
    told = sharding.write_shards(docs, f"file://{tmp_path}/s", limit=1000)
    files = spark.read.parquet(f"file://{tmp_path}/s").groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("bytes")).collect()
    assert {(r.shard, r.bytes, r.n) for r in files} == {(f"b{r.shard}", r.shard_bytes, r.shard_rows) for r in told.collect()}
    assert max(r.bytes for r in files) <= 1000 and sum(r.n for r in files) == 60
