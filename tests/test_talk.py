"""Statistics and order-dependent operators on small tables worked out by hand, and against plain loops."""

import random

from parley.operators import intervals, keywords, quality, sequence, stats
from parley.sources import tables


def rows(spark, data, columns="meeting_id long, seq long, speaker string, start_ms long, end_ms long"):
    return spark.createDataFrame(data, columns)


def test_speaker_stats(spark):
    u = rows(spark, [(1, 0, "A", 0, 10_000), (1, 1, "B", 10_000, 40_000), (1, 2, "A", 40_000, 50_000), (2, 0, None, 5_000, 0)])
    got = {(r.meeting_id, r.speaker): (r.n, r.total_ms, r.avg_ms, r.share_bp, r["rank"]) for r in stats.speaker_stats(u).collect()}
    assert got == {(1, "B"): (1, 30_000, 30_000, 6000, 1), (1, "A"): (2, 20_000, 10_000, 4000, 2), (2, "?"): (1, 0, 0, 0, 1)}


def test_time_distribution(spark):
    u = rows(spark, [(1, 0, "A", 0, 60_000), (1, 1, "A", 120_000, 180_000), (1, 2, "B", 700_000, 760_000)])
    got = [(r.bin, r.n, r.top_speaker, r.top_n, r.end_ms) for r in stats.time_distribution(u).orderBy("bin").collect()]
    assert got == [(0, 2, "A", 2, 600_000), (1, 1, "B", 1, 760_000)]
    tie = rows(spark, [(1, 0, "B", 0, 1), (1, 1, "A", 1, 2)])
    assert stats.time_distribution(tie).first().top_speaker == "B"


def test_until_of_a_day_leaves_the_day_out(spark):
    m = spark.createDataFrame([(1, "2026-12-31T10:00:00", 5), (2, None, 7), (3, "2026-11-30T00:00:00", 1)], "meeting_id long, created string, duration_ms long")
    u = spark.createDataFrame([(1, 0), (3, 0), (3, 1)], "meeting_id long, seq long")
    got = {r.month: (r.meetings, r.utterances) for r in stats.timeline(m, u, None, "2026-12-31").collect()}
    assert got == {"2026-11": (1, 2)}
    assert {r.month: r.meetings for r in stats.timeline(m, u).collect()} == {"2026-12": 1, "2026-11": 1, "(미상)": 1}


def test_keyword_trend_and_samples(spark):
    t = spark.createDataFrame([(1, "a", "aaa aa"), (2, "a", "AA"), (3, "b", None)], "meeting_id long, month string, text string")
    assert [tuple(r) for r in stats.keyword_trend(t, "aa").collect()] == [("a", 2, 1)]
    u = rows(spark, [(1, i, "A", i, i) for i in range(6)])
    assert {(r.seq, r.part) for r in stats.speaker_samples(u).collect()} == {(0, "first"), (1, "first"), (2, "first"), (4, "last"), (5, "last")}


def test_merge_against_a_loop(spark):
    rng = random.Random(5)
    data = []
    for m in range(20):
        at = 0
        for s in range(40):
            start = at + rng.choice([0, 500, 1000, 1001, -200])
            at = start + rng.randrange(0, 900)
            data.append((m, s, rng.choice(["A", "B", None]), start, at, f"t{s}", rng.choice([None, -1.0, -0.5])))
    want = []
    for m, s, who, start, end, text, lp in data:
        last = want[-1] if want else None
        if last and last[0] == m and last[2] == who and start - last[4] <= 1000:
            last[4], last[5] = end, last[5] + " " + text
            last[6] = min((x for x in (last[6], lp) if x is not None), default=None)
        else:
            want.append([m, s, who, start, end, text, lp])
    u = spark.createDataFrame(data, "meeting_id long, seq long, speaker string, start_ms long, end_ms long, text string, avg_logprob double").repartition(4)
    got = sequence.merge_consecutive(u).select("meeting_id", "seq", "speaker", "start_ms", "end_ms", "text", "avg_logprob").collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == [tuple(w) for w in want]


def test_remap_and_fill(spark):
    u = rows(spark, [(1, 0, "x", 0, 1), (1, 1, "UNKNOWN", 1, 2), (1, 2, "y", 2, 3), (1, 3, "x", 3, 4)])
    assert [r.label for r in sequence.remap_speakers(u).orderBy("seq").collect()] == ["사용자1", "미식별", "사용자2", "사용자1"]
    v = rows(spark, [(1, 0, None, 0, 1), (1, 1, "S1", 1, 2), (1, 2, None, 2, 3)])
    assert [r.filled for r in sequence.forward_fill(v).orderBy("seq").collect()] == ["SPEAKER_00", "S1", "S1"]


def test_windows_against_a_loop(spark):
    lengths = [0, 400, 500, 2500, 2501, 3000, 4600, 5000, 8000, 29_999]
    u = rows(spark, [(1, i, "A", 10_000, 10_000 + n) for i, n in enumerate(lengths)])
    got = {}
    for r in sequence.segment_windows(u).orderBy("seq", "k").collect():
        got.setdefault(r.seq, []).append((r.from_ms, r.to_ms))
    for i, n in enumerate(lengths):
        want, cur, end = [], 10_000, 10_000 + n
        while n >= 500 and cur < end:
            stop = min(cur + 2500, end)
            if stop - cur >= 500:
                want.append((cur, stop))
            if stop >= end:
                break
            cur += 2100
        assert got.get(i, []) == want


def test_chunks_against_a_loop(spark):
    rng = random.Random(2)
    data = []
    for m in range(30):
        at = 0
        for s in range(50):
            n = rng.randrange(1, 60_000)
            data.append((m, s, "A", at, at + n, rng.choice(["x", "word " * 3000, " "])))
            at += n
    want, last = [], None
    for m, s, who, start, end, text in data:
        if not text.strip():
            continue
        line = f"[00:00] {who}: {text}"
        if last is None or last["m"] != m:
            last = {"m": m, "c": 0, "t": start, "n": 0}
        elif end - last["t"] >= 300_000 or int((last["n"] + 1 + len(line)) * 0.5) + 2048 > 12_000:
            last = {"m": m, "c": last["c"] + 1, "t": start, "n": 0}
        last["n"] += len(line) + (1 if last["n"] else 0)
        want.append((m, s, last["c"]))
    u = spark.createDataFrame(data, "meeting_id long, seq long, speaker string, start_ms long, end_ms long, text string").repartition(5)
    assert sorted(map(tuple, sequence.chunk_utterances(u, 300_000).collect())) == want


def test_expansion_against_a_loop(spark):
    rng = random.Random(7)
    data = []
    for m in range(25):
        at = 0
        for s in range(30):
            at += rng.choice([0, 1000, 3000, 3001, 9000])
            n = rng.randrange(100, 4000)
            data.append((m, s, "A", at, at + n))
            at += n
    want = set()
    for m in range(25):
        u = [r for r in data if r[0] == m]
        best = max(range(len(u)), key=lambda i: (u[i][4] - u[i][3], -i))
        held, lo, hi = u[best][4] - u[best][3], best, best
        while held < 12_000 and hi + 1 < len(u) and u[hi + 1][3] - u[hi][4] <= 3000:
            hi += 1
            held += u[hi][4] - u[hi][3]
        while held < 12_000 and lo > 0 and u[lo][3] - u[lo - 1][4] <= 3000:
            lo -= 1
            held += u[lo][4] - u[lo][3]
        want |= {(m, u[i][1]) for i in range(lo, hi + 1)}
    got = sequence.expand_from_longest(rows(spark, data), 12_000, 3000).collect()
    assert {(r.meeting_id, r.seq) for r in got} == want


def test_overlap_against_all_pairs(spark):
    rng = random.Random(11)
    segs = [(m, i, "", s, s + rng.randrange(0, 200_000)) for m in range(5) for i, s in enumerate(rng.sample(range(10**6), 20))]
    turns = [(m, i, s, s + rng.randrange(1, 300_000), f"S{i % 4}") for m in range(4) for i, s in enumerate(rng.sample(range(10**6), 15))]
    want = {}
    for m, i, _, s, e in segs:
        best = (0, None)
        for tm, _, ts, te, who in turns:
            o = min(e, te) - max(s, ts)
            if tm == m and o > best[0]:
                best = (o, who)
        want[m, i] = best
    t = spark.createDataFrame(turns, "meeting_id long, turn_idx long, start_ms long, end_ms long, speaker string")
    got = intervals.assign_by_overlap(rows(spark, segs), t).collect()
    assert {(r.meeting_id, r.seq): (r.overlap_ms, r.assigned) for r in got} == want


def test_keywords(spark):
    texts = spark.createDataFrame([(0, "산업안전 사고 예방 회의"), (1, "산업안전 예방 사고 abc"), (2, "산업안전!! 교육")], "seq long, text string")
    assert [(r.word, r.n) for r in keywords.top_keywords(texts).orderBy("rank").collect()] == [("산업안전", 3), ("사고", 2), ("예방", 2)]
    assert [r.word for r in keywords.top_keywords(texts, exclude=["산업안전"], top=1, least=1).collect()] == ["사고"]
    both = spark.createDataFrame([(1, 0, "A", "가나 다라"), (2, 0, "B", "다라 마바"), (2, 1, "A", "")], "meeting_id long, seq long, speaker string, text string")
    got = {(r.kind, r.side, r.item) for r in keywords.compare_two(both, 1, 2).collect()}
    assert got == {("word", "both", "다라"), ("word", "a", "가나"), ("word", "b", "마바"), ("speaker", "both", "A"), ("speaker", "b", "B")}


def test_near_repeats_against_difflib(spark):
    from difflib import SequenceMatcher

    rng = random.Random(3)
    words = ["안녕하세요", "반갑습니다", "회의를", "시작하겠습니다", "내용은", "abc", "다음과", "같습니다"]
    data = [(m, s, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))) for m in range(12) for s in range(25)]
    want = {}
    for m in range(12):
        import re

        t = [re.sub("[^0-9a-z가-힣]", "", re.sub(r"\s+", "", x).lower()) for k, _, x in data if k == m]
        t = [x for x in t if len(x) >= 8]
        near = 0
        for a, b in zip(t, t[1:]):
            short, long_ = sorted((a, b), key=len)
            near += a == b or (len(short) >= 12 and short in long_) or SequenceMatcher(None, b, a).ratio() >= 0.86
        if t:
            want[m] = (len(t), len(set(t)), near) if len(t) >= 6 else (len(t), len(t), 0)
    u = spark.createDataFrame(data, "meeting_id long, seq long, text string")
    assert {r.meeting_id: (r.texts, r.distinct_texts, r.near_pairs) for r in sequence.repeats(u).collect()} == want


def judged(spark, data, duration_s):
    u = spark.createDataFrame([(1, i, *r) for i, r in enumerate(data)], "meeting_id long, seq long, speaker string, start_ms long, end_ms long, text string, avg_logprob double")
    d = spark.createDataFrame([(1, duration_s * 1000)], "meeting_id long, duration_ms long")
    r = quality.issues(quality.metrics(u, d)).first()
    return {c.code: c.severity for c in r.codes}, r.severity


def test_quality_rules(spark):
    assert judged(spark, [], 300) == ({"no_speech": "danger"}, "danger")
    codes, severity = judged(spark, [("A", i * 20_000, i * 20_000 + 15_000, "같은 말을 계속 반복하고 있습니다", -1.4) for i in range(12)], 240)
    assert severity == "danger" and codes["repeated_text"] == "danger" and codes["low_asr_confidence"] == "danger"
    long_talk = [("A", i * 18_000, i * 18_000 + 15_000, f"{i}번째 주제는 서로 다른 이야기를 담고 있는 충분히 긴 문장 {chr(0xAC00 + i * 53) * 9} {i * 7919}입니다", -1.0) for i in range(16)]
    codes, severity = judged(spark, long_talk, 300)
    assert codes == {"single_speaker_long": "warning", "low_asr_confidence": "warning"} and severity == "warning"
    assert judged(spark, [("A", 0, 1000, "짧다", None)], 120)[0]["too_few_utterances"] == "danger"
    gate = quality.upload_gate(spark.createDataFrame([("danger",), ("warning",)], "severity string"))
    assert [r.sync_status for r in gate.collect()] == ["blocked", "pending"]


def test_retry_rules(spark):
    t = spark.createDataFrame([(3, 30_000, 200, 390_000), (30, 250_000, 900, 300_000), (1, 1, 1, 59_000), (0, 0, 0, 60_000)], "n long, speech_ms long, chars long, duration_ms long")
    assert [r.x for r in t.select(quality.retry_without_vad(t).alias("x")).collect()] == [True, False, False, True]


def test_normalise_segments_and_sources(spark, tmp_path):
    s = spark.createDataFrame([(1, 0, "A", 1.5, None, "x")], "meeting_id long, seq long, speaker string, start double, end double, text string")
    assert tables.normalise_segments(s).first().asDict() == {"meeting_id": 1, "seq": 0, "speaker": "A", "start_ms": 1500, "end_ms": 1500, "text": "x", "avg_logprob": None, "no_speech_prob": None, "compression_ratio": None}
    (tmp_path / "a.csv").write_bytes("﻿term,pattern\n안전, \nx,y\n".encode())
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("안전", None), ("x", "y")]
    (tmp_path / "s.json").write_text('[{"start": 0, "end": 1.5, "text": "a"}, {"start": 2, "text": "b"}]')
    assert [(r.start, r.end, r.text) for r in tables.read_segments_json(spark, str(tmp_path / "s.json")).collect()] == [(0.0, 1.5, "a"), (2.0, None, "b")]
    for n in ("a.mp3", "b.WAV", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert tables.audio_files(spark, str(tmp_path)).count() == 2


def test_zip_needs_equal_counts(spark):
    a = spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "k long, a long")
    b = spark.createDataFrame([(1, 50), (1, 70), (2, 1), (2, 2)], "k long, b long")
    assert sorted((r.a, r.b) for r in intervals.positional_zip(a, b, "k", "a", "b").collect()) == [(5, 50), (7, 70)]
