"""Speaker clustering with its merges, and edits of stored tables."""

import numpy as np
from pyspark.sql import functions as F

from parley.operators import diarize, edits


def test_short_clusters():
    v = np.vstack([np.tile([1.0, 0, 0], (8, 1)), [[0.3, 0.43, 0.85]], np.tile([0.0, 0, 1], (8, 1))])
    labels = np.array([0] * 8 + [2] + [1] * 8)
    ms = np.full(17, 1000.0)
    assert diarize.merge_short(v, labels, ms, 2000).tolist() == [0] * 8 + [1] + [1] * 8  # beside it stands 0, which counts as none, so distance decides
    five = np.arange(5).repeat(2)
    assert len(set(diarize.merge_cautiously(np.eye(5).repeat(2, 0), five, np.full(10, 100.0)).tolist())) == 5


def test_similar_clusters():
    v = np.array([[1, 0.0], [1, 0.01], [0.99, 0.1], [0, 1.0]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert diarize.merge_similar(v, np.array([0, 0, 1, 2]), 0.1).tolist() == [0, 0, 0, 1]
    assert diarize.merge_similar(v, np.array([0, 0, 1, 2]), 0.001).tolist() == [0, 0, 1, 2]


def test_beside_against_a_loop():
    rng = np.random.default_rng(2)
    for _ in range(300):
        labels = rng.integers(0, 4, rng.integers(1, 15))
        of = int(labels[0])
        best = None
        for j, x in enumerate(labels.tolist()):
            if x != of:
                gap = min(abs(i - j) for i, y in enumerate(labels.tolist()) if y == of)
                if best is None or gap < best[0]:
                    best = (gap, x)
        assert diarize.beside(labels, of) == (best[1] if best else None)


def test_diarize(spark):
    rng = np.random.default_rng(3)
    base = np.eye(4)
    windows = [(1, s, s * 2 + k, s * 5000 + k * 2000, s * 5000 + k * 2000 + 2500, (base[s % 2] + rng.normal(0, 0.02, 4)).tolist()) for s in range(1, 9) if s != 5 for k in range(2)]
    w = spark.createDataFrame(windows, "meeting_id long, seq long, idx long, from_ms long, to_ms long, embedding array<double>")
    s = spark.createDataFrame([(1, i, i * 5000) for i in range(9)], "meeting_id long, seq long, start_ms long")
    who = [r.speaker for r in diarize.diarize(s, w).orderBy("seq").collect()]
    a, b = who[1], who[2]
    assert who == ["SPEAKER_00", a, b, a, b, b, b, a, b] and {a, b} == {"SPEAKER_00", "SPEAKER_01"}
    reg = spark.createDataFrame([("Kim", [0.0, 1.0, 0.0, 0.0])], "ref string, centroid array<double>")
    named = [r.speaker for r in diarize.diarize(s, w, 2, reg).orderBy("seq").collect()]
    assert named[1] == "Kim" and named[2] != "Kim"


def test_edits(spark):
    u = spark.createDataFrame([(1, 10, "A", "x"), (1, 11, None, "y"), (2, 20, "A", "z")], "meeting_id long, utterance_id long, speaker string, text string")
    new, n = edits.rename_speaker(u, 1, "A", "Kim")
    assert n.first().changed == 1 and {(r.utterance_id, r.speaker) for r in new.collect()} == {(10, "Kim"), (11, None), (20, "A")}
    assert edits.set_text(u, 20, "new")[0].where("utterance_id = 20").first().text == "new"
    m = spark.createDataFrame([(1, "t", "s")], "meeting_id long, title string, summary_md string")
    assert edits.set_summary(m, 1, summary_md="S")[0].first() == (1, "t", "S") and edits.set_summary(m, 1)[1].first().changed == 0
    left = edits.delete_meetings(m, u=u, m=m)
    assert left["u"].count() == 1 and left["m"].count() == 0
    seg = spark.createDataFrame([("b.wav", 0, 1000, "A", "x", 0), ("a.wav", 0, 500, "B", "y", 7), ("a.wav", 500, 900, "C", "z", 9)], "source_file string, start_ms long, end_ms long, speaker string, text string, place int")
    mm, uu = edits.new_meetings(seg, m, F.lit("now"))
    assert {(r.meeting_id, r.source_file, r.speaker_count) for r in mm.collect()} == {(2, "a.wav", 2), (3, "b.wav", 1)}
    assert {(r.meeting_id, r.seq, r.text) for r in uu.collect()} == {(2, 0, "y"), (2, 1, "z"), (3, 0, "x")}
