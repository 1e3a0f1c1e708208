"""Operators over pairs of documents, held against brute force."""

import random

from parley.llm import ngram_join, queries
from tests.conftest import SF
from tests.llm import brute


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def made(seed=1):
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [None, "", "  ", "a b", "A  b\n", "a b c", "a b c d e", "a b c d e f", *["Same old text " * 30] * 40]
    texts += family(rng, 120, 80, 6) + family(rng, 60, 40, 9) + family(rng, 25, 12, 3)
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(10, 200))) + " " + passage for _ in range(150)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 12))) + " " + passage for _ in range(60)]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


def held(spark, rows):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, rep int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute.op2(rows)
    return got


def test_join_against_brute_force(spark, monkeypatch):
    held(spark, made())
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "ROOM", 3)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    got = held(spark, made(2))
    assert len({c for _, c in got.values()}) < 350


def test_join_on_real_rows(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_ngram_join(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute.op2(rows)


def test_join_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "A b c"), (5, "x y z"), (9, "X y Z"), (4, None), (4, "q")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.near_duplicates(docs).collect())
    assert got == [("4", 0, "4"), ("4", 1, "4"), ("5", 1, "None"), ("5", 1, "None"), ("9", 1, "None"), ("None", 1, "None")]
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0
