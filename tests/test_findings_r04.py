"""What the findings of round 4 found."""


def test_keys_and_texts_of_rules_are_not_sent_through_the_driver(spark, monkeypatch, tmp_path):
    from parley.functions import dictionary

    plans, kept = [], dictionary.kept
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(dictionary, "kept", lambda df: plans.append(plan(df)) or kept(df))
    words = [f"{a}{b}xyz" for a in "abcdefgh" for b in "abcdefgh"]
    spark.createDataFrame([(i, "t", w, w[:2] + "~", "global", True) for i, w in enumerate([*words, "ab~ac~"])], "id long, term string, pattern string, replacement string, scope string, enabled boolean").write.parquet(f"{tmp_path}/rules")
    spark.createDataFrame([("abxyzacxyz", 0), ("hhxyz abxyz", 1), (None, 2)], "text string, i long").write.parquet(f"{tmp_path}/rows")
    got = dictionary.corrected(spark.read.parquet(f"{tmp_path}/rows"), "text", spark.read.parquet(f"{tmp_path}/rules"), block=20)
    joins = [p for p in [*plans, plan(got)] if "Join" in p and "rid" in p]
    assert len(joins) > 3 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in joins)  # the planner takes all of these tables for small ones
    assert {r.i: r.text for r in got.collect()} == {0: "ab~", 1: "hh~ ab~", 2: None}


def test_rounds_that_merge_few_end_also_in_larger_meetings(spark, monkeypatch):
    import numpy as np

    from parley.operators import linkage, vectors

    rounds, nearest = [], linkage.nearest

    def counted(clusters, block):
        rounds.append(1)
        assert len(rounds) <= 3
        return nearest(clusters, block)

    monkeypatch.setattr(linkage, "nearest", counted)
    a = 0.9 - 0.003 * np.arange(150)  # all are nearest to the cluster of the first, so a round merges one pair
    v = np.concatenate([a[:, None], np.diag(np.sqrt(1 - a**2))], 1)
    u = spark.createDataFrame([(1, i, x.tolist()) for i, x in enumerate(v)], "meeting_id long, idx long, embedding array<double>")
    got = linkage.merges(u, local=4, block=100).collect()
    assert len(rounds) == 1
    assert np.allclose(sorted(r.d for r in got), [m[0] for m in vectors.chained_linkage(v)])


def test_lists_of_near_clusters_merge_as_the_chain():
    import numpy as np

    from parley.operators import vectors

    rng = np.random.default_rng(8)
    for n, kind in ((1, 0), (2, 1), (40, 0), (300, 1), (400, 2)):
        v = rng.normal(0, 1, (n, 6)) + (rng.normal(0, 2, (3, 6))[rng.integers(0, 3, n)] if kind else 0)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        sizes = rng.integers(1, 50, n) if kind == 2 else None
        v = v if sizes is None else v * sizes[:, None] * 0.8
        got, want = vectors.listed_linkage(v, sizes), vectors.chained_linkage(v, sizes)
        assert np.allclose([m[0] for m in got], [m[0] for m in want]) and {m[1:] for m in got} == {m[1:] for m in want}
    copies = np.repeat(v[:50], 6, 0)
    copies /= np.linalg.norm(copies, axis=1, keepdims=True)
    got, want = vectors.listed_linkage(copies), vectors.chained_linkage(copies)
    assert all((vectors.cut(got, 300, k) == vectors.cut(want, 300, k)).all() for k in (2, 8, 50))


def test_nearest_of_two_blocks_by_strips():
    import numpy as np

    from parley.operators import linkage

    rng = np.random.default_rng(9)
    for same in (False, True):
        x = rng.integers(-1, 2, (40, 3)).astype(float)  # with ties
        y = x if same else rng.integers(-1, 2, (30, 3)).astype(float)
        cx, cy = np.arange(40) * 3, np.arange(len(y)) * 3 + (0 if same else 1000)
        d = 1 - x @ y.T
        if same:
            np.fill_diagonal(d, np.inf)
        for strip in (1, 50, 10**6):
            rows, cols = linkage._nearest(x, y, cx, cy, same, strip)
            assert (rows[0] == d.min(1)).all() and (rows[1] == cy[d.argmin(1)]).all() and (cols[0] == d.min(0)).all() and (cols[1] == cx[d.argmin(0)]).all()
