"""What the findings of round 3 found."""

import duckdb

from parley.plans import ORACLE_SQL, QUERIES


def as_sql(spark, path, query, **views):
    db = duckdb.connect()
    for name in views:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet/*.parquet')")
    return [tuple(r) for r in QUERIES[query](spark, str(path)).collect()], db.execute(ORACLE_SQL[query]).fetchall()


def test_terms_that_overlap_themselves_count_as_in_sql(spark, tmp_path):
    docs = [(1, "src3", "The thing thathat ent"), (2, "src3", "that ent"), (3, "src1", "thathathat thing"), (4, "src2", "thing thathathat that"), (5, None, None)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query in ("search_boolean", "search_filtered"):
        got, want = as_sql(spark, tmp_path, query, documents=docs)
        assert got == want and want


def test_many_rules_need_no_step_of_their_own(spark, monkeypatch):
    from parley.functions import dictionary

    sent = []
    send = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(1) or send(self, value))
    words = [f"{a}{b}{c}xyz" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    rules = [(w, w[:3] + "~") for w in words] + [("one~", "oneone"), ("oneone", "oneoneone"), (r"h+a\b", "<\\g<0>>"), ("né", "a" * 30 + "abcxyz"), ("a" * 30, "b" * 70), ("b" * 70 + "abcxyz", "end")]
    frame = spark.createDataFrame([(i, "t", p, to, "global", True) for i, (p, to) in enumerate(rules)], "id long, term string, pattern string, replacement string, scope string, enabled boolean")
    texts = ["abcxyzabdxyz hha", "hhhxyz one~ one~", "né né x", "", None, "hha", "b" * 71 + "abcxyz", "😀abcxyz né"]

    def plain(text):
        import re

        for p, to in rules:
            text = re.sub(p, to, text)
        return text

    rows = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, i long").repartition(3)
    got = {r.i: r.text for r in dictionary.corrected(rows, "text", frame, block=50).collect()}
    assert got == {i: None if t is None else plain(t) for i, t in enumerate(texts)}
    assert len(sent) == 1  # not a step for each block of rules


def test_postings_of_a_bucket_are_several_tasks(spark):
    from parley.operators import postings

    rows = spark.createDataFrame([(i, f"src{i % 3}", "the phrase the phrase " * (i % 4) + "the") for i in range(300)] + [(900, None, None)], "id long, title string, body string")
    spark.sql("DROP TABLE IF EXISTS many_tasks")
    try:
        for part in ("id % 2 = 0", "id % 2 = 1"):
            postings.add(rows.where(part), ["title", "body"], "many_tasks", 4, task_chars=700)
        files = spark.table("many_tasks").selectExpr("input_file_name() AS f", "pmod(hash(gram), 4) AS b").distinct().collect()
        # a file is of one bucket still, and a bucket has several files of each batch
        assert len({r.f for r in files}) == len(files) > 16
        for phrase, want in (("THE phrase", {i: i % 4 * 2 for i in range(300) if i % 4}), ("src1", {i: 1 for i in range(300) if i % 3 == 1})):
            hits = postings.phrase_hits(spark, "many_tasks", phrase, task_places=50)
            assert {r.id: r.hits for r in hits.collect()} == want
        # nothing is put together in the task that reads a bucket
        plan = hits._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.index("REPARTITION_BY_NUM") > plan.rindex("HashAggregate(keys=[id")
    finally:
        spark.sql("DROP TABLE IF EXISTS many_tasks")


def test_short_meetings_share_a_group(spark):
    from parley.operators import sequence

    rows = [(m, i, "A", i * 900, i * 900 + 700 + m % 5 * 300, "said " * (1 + (m + i) % 9)) for m in range(60) for i in range(m % 12)] + [(99, i, None, i * 400, i * 400 + 900, "x" * (i % 40 + 1)) for i in range(4000)]
    u = spark.createDataFrame(rows, "meeting_id long, seq long, speaker string, start_ms long, end_ms long, text string").repartition(3)
    got = sequence.chunk_by_jumps(u, 5_000, block=1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sequence.chunk_utterances(u, 5_000).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas [group" in plan and "FlatMapGroupsInPandas [meeting_id" not in plan


def test_rounds_of_linkage_do_not_multiply_the_planned_size(spark, monkeypatch):
    import numpy as np

    from parley.operators import linkage, vectors

    planned, nearest = [], linkage.nearest
    monkeypatch.setattr(linkage, "nearest", lambda clusters, block: planned.append(int(clusters._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) or nearest(clusters, block))
    v = np.random.default_rng(5).normal(0, 1, (120, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    u = spark.createDataFrame([(1, i, x.tolist()) for i, x in enumerate(v)], "meeting_id long, idx long, embedding array<double>")
    got = linkage.merges(u, local=20, block=70).collect()
    assert len(planned) >= 4 and max(planned) < 1_000_000  # of 120 rows
    assert np.allclose(sorted(r.d for r in got), [m[0] for m in vectors.chained_linkage(v)])


def test_hashes_are_sorted_and_found_also_where_they_begin_alike():
    import numpy as np

    from parley.llm import pitman_yor as lm

    rng = np.random.default_rng(7)
    h = lm.mix(rng.integers(0, 3000, 20_000).astype(np.uint64))
    close = np.concatenate([h, h[:300] ^ np.uint64(3), h[:300] ^ np.uint64(1)])
    for x in (h, close, h & ~np.uint64(0xFFFFFFFF), np.sort(h), h[:1], h[:0], rng.integers(0, 9, 5000).astype(np.uint64)):
        order, got = lm.in_order(x)
        assert (order == np.argsort(x, kind="stable")).all() and (got == x[order]).all()
    for known in (np.unique(h), np.unique(close), np.unique(h)[:1], np.unique(h)[:3], h[:0]):
        asked = np.concatenate([close, known, np.array([0, (1 << 64) - 1], np.uint64)])
        want, got = lm.among(known, asked), lm.Known(known).among(asked)
        assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def test_words_are_moved_packed(spark, monkeypatch):
    from collections import Counter

    from parley.llm import pitman_yor as lm

    plans, materialise = [], lm.materialise
    monkeypatch.setattr(lm, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or materialise(df, name))
    texts = [(i % 3 == 0, f"a b{i % 5} A c{i % 7}" if i % 11 else None) for i in range(200)]
    got = lm.count_words(spark.createDataFrame(texts, "held boolean, text string")).collect()
    words = [(held, w) for held, text in texts for w in [*(text or "").lower().split(), "\n"]]
    all_, train = Counter(w for _, w in words), Counter(w for held, w in words if not held)
    assert sorted((r.n, r.c) for r in got) == sorted((n, train[w]) for w, n in all_.items())
    assert "Aggregate" not in plans[0]  # a row for each word and run of texts was moved
