"""Suffix arrays and the removal of repeated strings, held against brute force."""

import random

import numpy as np

from parley.llm import queries, suffix_dedup
from parley.llm.suffix_array import suffix_array
from tests.conftest import SF
from tests.llm import brute


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(800):
        n, k = rng.randrange(60), rng.choice([1, 2, 3, 20])
        t = np.array([rng.randrange(1, k + 1) for _ in range(n)], np.int64)
        assert suffix_array(t, 10**9).tolist() == sorted(range(n), key=lambda i: tuple(t[i:].tolist()))
        for depth in (3, 5, 20):
            heads = [tuple(t[i : i + depth].tolist()) for i in suffix_array(t, depth).tolist()]
            assert heads == sorted(heads)


def made(rng):
    def text(n):
        return "".join(rng.choice("abcdefgh é\n") for _ in range(n))

    passage, near = text(260), text(700)
    texts = [None, "", "x" * 99, "x" * 100, "x" * 1000, "ab" * 300, "q" * 150 + "r" + "q" * 150, text(100), text(99)]
    texts += [passage[: rng.randrange(90, 260)] for _ in range(10)]
    texts += [text(rng.randrange(60)) + passage[rng.randrange(30) : rng.randrange(130, 260)] + text(rng.randrange(60)) for _ in range(80)]
    for _ in range(30):
        i = rng.randrange(700)
        texts.append(near[:i] + text(rng.randrange(3)) + near[i + rng.randrange(3) :])
    texts += [near] * 12 + [text(300) + near[100:350] + text(20) + near[100:350]]
    return texts


def test_removal_against_brute_force(spark, monkeypatch):
    for seed in (1, 2):
        rng = random.Random(seed)
        texts = made(rng)
        rows = list(zip(rng.sample(range(-50, 5000), len(texts)), texts, strict=True))
        docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, data string").repartition(5)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeats_report(docs).collect()}
        assert got == brute.op9(rows)
        monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 10)


def test_removal_on_real_rows(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op9_suffix_dedup(spark, SF).collect()}
    assert got == brute.op9(rows)


def test_removal_odd_rows(spark):
    a, b = "".join(map(chr, range(40, 160))), "z" * 120
    docs = spark.createDataFrame([(None, a), (1, a), (1, a), (2, b), (2, "y" + b), (3, b)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    n = len(a.encode())
    assert got == [("1", n, n), ("1", n, n), ("2", 120, 119), ("2", 121, 120), ("3", 120, 120), ("None", n, 0)]
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
