"""Queries and operators on whole inputs."""

import numpy as np
from pyspark.sql import functions as F

from parley.operators import diarize, vectors
from parley.plans import QUERIES
from parley.sources import tables
from tests.conftest import SF


def test_targets_are_whole(spark):
    rows = [tuple(r) for r in tables.order_targets(spark, SF).select("meeting_id", "target", "status", "post_id", "error", "updated").collect()]
    want = sorted(((m, t, s, int(t != "1-URGENT"), u) for m, t, s, _, _, u in rows), key=lambda r: (r[0], r[3], r[4], r[1]))
    assert [tuple(r) for r in QUERIES["target_order"](spark, SF).collect()] == want
    for name, is_new in (("upsert_targets", lambda m: m % 2 == 0), ("insert_or_ignore", lambda m: m % 3 == 0)):
        got = QUERIES[name](spark, SF).select("meeting_id", "target", "status", "post_id", "error", "updated").collect()
        want = [(m, t, "partial", ("new" if m % 4 == 0 else p if name == "upsert_targets" else None), None, u) if is_new(m) else (m, t, s, p, e, u) for m, t, s, p, e, u in rows]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_zip_is_whole(spark):
    by = {}
    for r in tables.event_utterances(spark, SF).select("meeting_id", "seq", "end_ms").collect():
        by.setdefault(r.meeting_id, []).append((r.seq, r.end_ms))
    want = {(m, i + 1, a, b) for m, x in by.items() for i, (a, b) in enumerate(zip(sorted(s for s, _ in x), [s for s, _ in sorted(x, key=lambda y: (y[1], y[0]))], strict=True))}
    got = [(r.meeting_id, r.pos, r.a, r.b) for r in QUERIES["positional_zip"](spark, SF).collect()]
    assert len(got) == len(want) == sum(map(len, by.values())) and set(got) == want and max(p for _, p, _, _ in got) > 60


def test_no_meeting_and_no_registry_is_too_large(spark):
    rng = np.random.default_rng(5)
    u = rng.normal(size=(150, 6))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for k in (1, 2, 5, 40):
        assert vectors.linked(u, k).tolist() == vectors.average_linkage(1 - u @ u.T, k).tolist()
    base = np.eye(4)
    rows = [(1, i, i * 1000, i * 1000 + 900, i, (base[i % 3] + rng.normal(0, 0.05, 4)).tolist()) for i in range(60)]
    w = spark.createDataFrame(rows, "meeting_id long, idx long, from_ms long, to_ms long, seq long, embedding array<double>")
    for f in (vectors.cluster_meetings, diarize.cluster_windows):
        for speakers in (None, 3):
            got = [sorted((r.idx, r.label) for r in f(w, speakers, one_task=n).collect()) for n in (30, 100)]
            assert got[0] == got[1] and len({x for _, x in got[0]}) == 3
    refs = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(30)] + [(99, [1.0, 0.0, 0.0, 0.0]), (98, [1.0, 0.0, 0.0, 0.0])], "ref long, centroid array<double>")
    find = lambda **o: sorted((r.idx, r.ref, round(r.similarity, 9)) for r in vectors.match(w, refs, 0.2, **o).collect())
    assert find() == find(block_numbers=20)
