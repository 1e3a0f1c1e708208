"""Rules without a cap, ids, pages as files, nearest references, clustering of large meetings, pending files, re-runs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import dictionary
from parley.operators import diarize, edits, intervals, linkage, numbering, postings, vectors
from parley.sources import export


def plain_inline(t):
    import html

    t = re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", html.escape(t))
    return re.sub(r"(?<!\*)\*([^*]+)\*(?!\*)", r"<em>\1</em>", t)


def plain_markdown(md):
    """Blocks by a small state machine: the depth of open lists and the lines of an open paragraph."""
    out, depth, para = [], 0, []

    def flush(to=0):
        nonlocal depth, para
        if para:
            out.append(f"<p>{plain_inline(' '.join(para).strip())}</p>")
            para = []
        out.extend(["<ul>"] * (to - depth) + ["</ul>"] * (depth - to))
        depth = to

    for line in (x.rstrip() for x in (md or "").split("\n")):
        head, item = re.match(r"(#{1,4})\s+(.*)", line), re.match(r"(\s*)[-*]\s+(.*)", line)
        if not line:
            flush()
        elif head:
            flush()
            out.append(f"<h{len(head[1])}>{plain_inline(head[2].strip())}</h{len(head[1])}>")
        elif item:
            flush(len(item[1]) // 2 + 1)
            said = item[2].strip()
            box = re.match(r"\[([ x])\]\s+(.*)", said)
            out.append(f"<li>{plain_inline(('☑ ' if box[1] == 'x' else '☐ ') + box[2] if box else said)}</li>")
        else:
            if not para:
                flush()
            para.append(line)
    flush()
    return "\n".join(out)


def test_markdown_blocks(spark):
    r = random.Random(3)
    lines = ["# a *b*", "##  t ", "##### no", "- x", "  - y **z**", "      * deep", "- [x] done", "- [ ] open", "-", "", "  ", "plain & <i>", "**over", "lines** end ", "\tbent", "#", "[x] text"]
    texts = ["## 제목\n- 항목1\n- 항목2\n\n일반 단락", "- [x] 완료된 일\n- [ ] 남은 일", "", None] + ["\n".join(r.choice(lines) for _ in range(r.randrange(1, 12))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", export.markdown_html(F.col("t")).alias("h")).collect()
    assert {g.i: g.h for g in got} == {i: plain_markdown(t) for i, t in enumerate(texts)}
    assert "☑ 완료된 일" in got[1].h and "<ul>\n<li>항목1</li>\n<li>항목2</li>\n</ul>" in got[0].h


def test_pages_are_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"a/b:{i}", f"<p>{i} é</p>") for i in range(30)], "meeting_id long, title string, html string").repartition(4)
    export.write_pages(pages, str(tmp_path / "out"))
    files = {f.name: f.read_text() for f in (tmp_path / "out").iterdir()}
    assert files == {f"{i}_a_b_{i}.html": f"<p>{i} é</p>" for i in range(30)}
    # a job that fails leaves what was there, whole, and nothing else
    bad = pages.withColumn("html", F.when(F.col("meeting_id") == 29, F.raise_error(F.lit("broken"))).otherwise("new"))
    with pytest.raises(Exception, match="broken"):
        export.write_pages(bad, str(tmp_path / "out"))
    # a task that still ran may have left its own folder, whose name readers pass over
    assert {f.name: f.read_text() for f in (tmp_path / "out").iterdir() if f.is_file()} == files
    export.write_pages(pages.where("meeting_id < 3").drop("title"), f"file://{tmp_path}/out", overwrite=False)
    assert len(list((tmp_path / "out").glob("*.html"))) == 33
    export.write_pages(pages.where("meeting_id < 3").drop("title"), f"file:{tmp_path}/out")
    assert sorted(f.name for f in (tmp_path / "out").glob("*.html")) == ["0.html", "1.html", "2.html"]


def plain_rules(text, rules):
    for pattern, to in rules:
        try:
            text = re.sub(pattern, to or "t", text)  # an empty replacement is the term
        except re.error:
            continue
    return text


def test_any_number_of_rules(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randrange(4, 8)))
    rules = [(word(), word()) for _ in range(12_000)] + [(r"(\w)\1+x?", r"<\1>"), ("[", "never"), (r"(?i)ABC", "q"), (r"^a", "A"), (r"b\Z", r"\9"), (r"ab+c|zz", "."), (r"(?<=a)b", "")]
    r.shuffle(rules)
    frame = spark.createDataFrame([(i, "t", p, to, "global", True) for i, (p, to) in enumerate(rules)], "id long, term string, pattern string, replacement string, scope string, enabled boolean")
    texts = [" ".join(word() for _ in range(20)) for _ in range(40)] + ["", None]
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "i long, text string, k long")
    want = {i: None if t is None else plain_rules(t, rules) for i, t in enumerate(texts)}
    for block in (50_000, 5_000):
        got = dictionary.corrected(rows, "text", frame, block=block)
        assert got.columns == rows.columns and {x.i: x.text for x in got.collect()} == want
    assert dictionary.corrected(rows, "text", frame.limit(0)).count() == len(texts)
    assert dictionary.needed_text(r"foo\d+barbaz$") == "barbaz" and dictionary.needed_text("a|b") == "" and dictionary.needed_text("(?i)abc") == ""


def test_terms_of_one_key_are_one_rule(spark):
    rules = spark.createDataFrame([(1, "a", None, "x", "global", False), (2, "b", "p", "y", "team", True)], "id long, term string, pattern string, replacement string, scope string, enabled boolean")
    new = spark.createDataFrame([("a", None, "1", None, 1), ("a", "", "0", "global", 2), ("c", None, "z", None, 1), ("c", "", "w", "global", 2), ("b", "p", "n", "team", 1)], "term string, pattern string, replacement string, scope string, at int")
    got = sorted(tuple(r) for r in dictionary.upsert_terms(rules, new, "at").select("id", "term", "replacement", "scope", "enabled").collect())
    assert got == [(1, "a", "0", "global", True), (2, "b", "n", "team", True), (3, "c", "w", "global", True)]


def test_numbers_are_dense(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, None if i % 9 == 0 else f"s{i % 50:02d}") for i in range(5000)], "a long, b string")
    got = numbering.numbered(rows, ["b", "a"], "n", F.lit(10), parts=7).collect()
    assert sorted(r.n for r in got) == list(range(11, 5011))
    ordered = sorted(got, key=lambda r: r.n)
    assert [(r.b or "", r.a) for r in ordered] == sorted((r.b or "", r.a) for r in got)
    assert numbering.numbered(rows.limit(0), ["a"]).collect() == []
    seg = spark.createDataFrame([(f"f{i:03d}", 0, 1000, "A", "x", 0) for i in range(200)], "source_file string, start_ms long, end_ms long, speaker string, text string, place long")
    m, u = edits.new_meetings(seg, spark.createDataFrame([(41,)], "meeting_id long"))
    assert sorted((r.meeting_id, r.source_file) for r in m.collect()) == [(42 + i, f"f{i:03d}") for i in range(200)] and u.count() == 200


def test_nearest_of_many_references(spark):
    rng = np.random.default_rng(4)
    refs = [(f"r{i:03d}", x.tolist()) for i, x in enumerate(rng.normal(size=(300, 8)))] + [("r999", None), ("a", None), ("r000b", None)]
    refs[-1] = ("a0", refs[0][1])  # the same vector under a smaller name
    rows = [(i, x.tolist(), "kept") for i, x in enumerate(rng.normal(size=(500, 8)))] + [(500, refs[0][1], "kept"), (501, [0.0] * 8, "kept"), (502, None, "kept")]
    v = spark.createDataFrame(rows, "id long, embedding array<double>, similarity string").repartition(3)
    r = spark.createDataFrame(refs, "ref string, centroid array<double>")
    unit = lambda x: np.array(x) / max(np.linalg.norm(x), 1e-300)
    known = sorted((n, unit(c)) for n, c in refs if c)
    want = {}
    for i, x, _ in rows:
        s = [round(float(np.clip(unit(x or [0.0] * 8) @ c, -1, 1)), 9) for _, c in known]
        want[i] = (known[s.index(max(s))][0], max(s))
    for block in (10_000, 500):  # one block, and five
        got = {x.id: (x.ref, round(x.similarity, 9)) for x in vectors.match(v, r, block_numbers=block).collect()}
        assert got == want and want[500][0] == "a0"
    assert {x.ref for x in vectors.match(v, r, 2.0, block_numbers=500).collect()} == {None}
    assert {x.ref for x in vectors.match(v, r.limit(0)).collect()} == {None} and vectors.match(v.limit(0), r, block_numbers=500).collect() == []


def windows_of(meetings, sizes, seed=0, width=6, noise=0.25):
    rng = np.random.default_rng(seed)
    out = []
    for m, n in zip(meetings, sizes, strict=True):
        base = np.eye(width)
        out += [(m, i, (base[rng.integers(0, 4)] + rng.normal(0, noise, width)).tolist()) for i in range(n)]
    return out


def test_a_large_meeting_is_clustered_by_many_tasks(spark):
    rows = windows_of([1, 2, 3], [160, 90, 3])
    w = spark.createDataFrame(rows, "meeting_id long, idx long, embedding array<double>").repartition(5)
    for speakers in (None, 5):
        one, many = (sorted(tuple(r) for r in vectors.cluster_meetings(w, speakers, one_task=k).collect()) for k in (10_000, 50))
        assert one == many and len(one) == 253
    # against the plain procedure: the two nearest clusters, again and again
    v = np.array([x for m, _, x in rows if m == 1])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    plain = vectors.average_linkage(1 - v @ v.T, 5)
    mine = [x for m, _, x in many if m == 1]
    assert len(set(zip(plain.tolist(), mine, strict=True))) == 5
    said = w.select("*", F.floor(F.col("idx") / 2).alias("seq"), (F.col("idx") * 100).alias("from_ms"), (F.col("idx") * 100 + 90).alias("to_ms"))
    one, many = (sorted((r.meeting_id, r.idx, r.label) for r in diarize.cluster_windows(said, one_task=k).collect()) for k in (10_000, 50))
    groups = lambda rows: {frozenset(i for m, i, x in rows if (m, x) == key) for key in {(m, x) for m, _, x in rows}}
    assert groups(one) == groups(many)


def test_merges_in_rounds_are_those_of_a_chain(spark):
    rows = windows_of([9], [900], seed=1)
    w = spark.createDataFrame(rows, "meeting_id long, idx long, embedding array<double>").repartition(8)
    u = w.select("meeting_id", "idx", vectors.unit(F.col("embedding")).alias("embedding"))
    got = linkage.merges(u, local=500, block=300).collect()
    v = np.array([x for _, _, x in rows])
    want = vectors.chained_linkage(v / np.linalg.norm(v, axis=1, keepdims=True))
    assert len(got) == 899 and np.allclose(sorted(r.d for r in got), [m[0] for m in want], atol=1e-9)
    mine = [(r.d, r.i, r.j) for r in sorted(got, key=lambda r: r.d)]
    for k in (2, 5, 8):
        a, b = vectors.cut(mine, 900, k), vectors.cut(want, 900, k)
        assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == k


def test_centroids_of_hot_and_odd_keys(spark):
    rows = [(None if i % 3 else i % 7, [float(i), 1.0]) for i in range(1000)] + [(50, None), (51, [3.0, None])]
    got = {r.k: (r.n, [round(x, 9) for x in r.centroid]) for r in vectors.centroids(spark.createDataFrame(rows, "k long, embedding array<float>").repartition(4), ["k"]).collect() if r.k != 50}
    for k in {r[0] for r in rows} - {50}:
        m = np.nan_to_num(np.array([x for j, x in rows if j == k], float)).mean(0)
        assert got[k] == (sum(j == k for j, _ in rows), [round(x, 9) for x in (m / np.linalg.norm(m)).tolist()])


def test_young_files_come_later(spark, tmp_path):
    import os
    import time

    from parley.streaming import pending

    folder, state, check = tmp_path / "in", f"file://{tmp_path}/state", str(tmp_path / "check")
    folder.mkdir()
    put = lambda name, age, body=b"x": ((folder / name).write_bytes(body), os.utime(folder / name, (time.time() - age,) * 2))
    seen = []

    def run(more=()):
        stream = pending.complete_audio_stream(spark, str(folder), state, 30)
        query = stream.writeStream.foreachBatch(lambda df, n: seen.append(sorted((os.path.basename(r.path), r.length) for r in df.collect()))).option("checkpointLocation", check).start()
        try:
            query.processAllAvailable()
            for step in more:
                step()
                query.processAllAvailable()
                time.sleep(0.5)
                query.processAllAvailable()
        finally:
            query.stop()

    put("old.wav", 100)
    put("young.mp3", 0)
    put("empty.wav", 100, b"")
    put("notes.txt", 100)
    run([lambda: put("young.mp3", 60)])  # it ripens within one query
    put("empty.wav", 5000, b"later")  # its time of change lies before what was handed on
    put("late.MP3", 40)
    run()  # and over a restart
    run()
    flat = [x for batch in seen for x in batch]
    assert sorted(flat) == [("empty.wav", 5), ("late.MP3", 1), ("old.wav", 1), ("young.mp3", 1)] and seen[0] == [("old.wav", 1)]


def test_reruns_of_incomplete_work(spark, tmp_path):
    from parley.streaming import rerun

    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    t = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"

    def deliver(rows):
        frame = spark.createDataFrame(rows, "meeting_id long, target string, seq long, status string, post_id string, error string, at string").withColumn("at", F.to_timestamp("at"))
        frame.coalesce(1).write.mode("append").json(src)
        events = spark.readStream.schema(rerun.EVENTS).json(src)
        query = rerun.reruns(events, (60, 120), "0 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.meeting_id, r.target, r.kind, r.status, r.attempts, r.post_id) for r in spark.read.parquet(out).collect())

    first = [(1, "a", 1, "failed", None, "boom", t(0)), (2, "a", 1, "synced", "p2", None, t(0)), (1, "b", 1, "pending", None, None, t(0))]
    deliver(first)
    got = deliver([*first, (9, "x", 1, "pending", None, None, t(61))])  # replays change nothing; the clock goes on past the first wait
    assert [g for g in got if g[0] == 1 and g[1] == "a"] == [(1, "a", "attempt", "failed", 1, None), (1, "a", "state", "failed", 1, None)]
    deliver([(1, "a", 2, "partial", "p1", "half", t(70))])
    got = deliver([(9, "x", 2, "pending", None, None, t(200)), (1, "a", 1, "failed", None, "boom", t(200))])
    assert [g[2:] for g in got if g[:2] == (1, "a")].count(("attempt", "partial", 2, "p1")) == 1
    got = deliver([(1, "a", 3, "synced", None, None, t(201)), (9, "x", 3, "pending", None, None, t(1000))])
    mine = [g[2:] for g in got if g[:2] == (1, "a")]
    assert mine.count(("state", "synced", 0, "p1")) == 1 and sum(m[0] == "attempt" for m in mine) == 2
    assert [g for g in got if g[0] == 2] == [(2, "a", "state", "synced", 0, "p2")]


def test_stored_postings(spark):
    r = random.Random(8)
    rows = [(i, "".join(r.choice("abAé𝄞 ") for _ in range(r.randrange(0, 60))), r.choice([None, "", "ab", "aaaa aaaa"])) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, title string, body string")
    spark.sql("DROP TABLE IF EXISTS postings_test")
    for part in (frame.where("id < 100"), frame.where("id >= 100")):
        postings.store(postings.postings(part, ["title", "body"]), "postings_test", 8)
    for phrase in ("aaa", "AB ", "aaaa", "é𝄞 ", "bbab", "ab", "zzz"):
        low, count = phrase.lower(), lambda x: sum(x.startswith(low, k) for k in range(len(x)))  # noqa: B023
        want = {i: n for i, a, b in rows if (n := count((a or "").lower()) + count((b or "").lower()))} if len(phrase) > 2 else {}
        assert {x.id: x.hits for x in postings.phrase_hits(spark, "postings_test", phrase).collect()} == want
    plan = postings.phrase_hits(spark, "postings_test", "aaa")._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 8" in plan
    spark.sql("DROP TABLE postings_test")


def test_sweep_is_the_overlap_join(spark):
    r = random.Random(9)
    seg = [(m, i, s := r.randrange(0, 2000), s + r.randrange(-5, 60)) for m, n in ((1, 800), (2, 40), (3, 5)) for i in range(n)]
    turn = [(m, i, s := r.randrange(0, 2000), s + r.choice([0, 10, 40, 3000]), f"s{i % 9}") for m, n in ((1, 300), (2, 20), (4, 3)) for i in range(n)] + [(1, 900 + i, -100, 5000, f"all{i}") for i in range(50)]
    a = spark.createDataFrame(seg, "meeting_id long, seq long, start_ms long, end_ms long")
    b = spark.createDataFrame(turn, "meeting_id long, turn_idx long, start_ms long, end_ms long, speaker string")
    want = {}
    for m, i, s, e in seg:
        found = [(min(e, te) - max(s, ts), -k, who) for n, k, ts, te, who in turn if n == m and min(e, te) > max(s, ts)] if e > s else []
        want[m, i] = (max(found)[2], max(found)[0]) if found else (None, 0)
    got = {(x.meeting_id, x.seq): (x.assigned, x.overlap_ms) for x in intervals.assign_by_sweep(a, b, 9).collect()}
    assert got == want
    assert {x.assigned for x in intervals.assign_by_sweep(a, b.limit(0), 3).collect()} == {None} and intervals.assign_by_sweep(a.limit(0), b, 3).collect() == []


def test_small_parity(spark):
    from parley.functions import text
    from parley.operators import sequence

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(sequence.recommended_context(F.lit(x))) for x in (5000, 100, 10**9)] == [5120, 4096, 131072]
    big = one(sequence.context_fit(F.repeat(F.lit("가"), F.lit(200_000)), 8192))
    assert not big.fits and big.tokens == 102_048 and big.recommended > 8192 and one(sequence.context_fit(F.lit("짧은 회의 내용"))).fits
    assert one(text.title_of_reply(F.lit('{"title":"좋은제목","summary_md":"x"}'))) == "좋은제목" and one(text.title_of_reply(F.lit("깨진 응답"))) == "회의록"
    texts = ["이번 터론은 집단지선에 필요한 주제들", "짧은 말", "c"]
    fixed = lambda raw: one(dictionary.corrected_items(F.lit(raw), F.array(*(F.lit(x) for x in texts))))
    assert fixed('{"items":[{"i":0,"text":"이번 토론은 집단지성에 필요한 주제들"},{"i":"1","text":"' + "x" * 200 + '"},{"i":9,"text":"y"},3,{"text":"z"},{"i":2,"text":"d"},{"i":2,"text":"e"}]}') == ["이번 토론은 집단지성에 필요한 주제들", "짧은 말", "e"]
    assert fixed('{"items": {"i": 0}}') is None and fixed("nothing") is None and fixed('{"items": []}') == texts
    u = spark.createDataFrame([(1, i, None if i == 4 else f"t{i}" if i < 5 else " ") for i in range(9)], "meeting_id long, seq long, text string")
    got = sorted((x.batch, x.seqs, x.texts, x.request) for x in dictionary.correction_batches(u, 3).collect())
    assert got == [(0, [0, 1, 2], ["t0", "t1", "t2"], '{"items":[{"i":0,"text":"t0"},{"i":1,"text":"t1"},{"i":2,"text":"t2"}]}'), (1, [3, 4, 5], ["t3", "", " "], '{"items":[{"i":0,"text":"t3"},{"i":1,"text":""},{"i":2,"text":" "}]}')]


def test_chunks_by_jumps(spark):
    from parley.operators import sequence

    r = random.Random(12)
    rows = []
    for m, n in ((1, 6000), (2, 300), (3, 1)):
        at = 0
        for i in range(n):
            at += r.randrange(0, 4000)
            rows.append((m, i, r.choice(["A", None, ""]), at, None if r.random() < 0.01 else at + r.choice([100, 2000, 60_000]), r.choice(["x", " ", "word " * r.randrange(1, 200), None])))
    u = spark.createDataFrame(rows, "meeting_id long, seq long, speaker string, start_ms long, end_ms long, text string").repartition(3)
    for ms in (900_000, 45_000, 0):
        want = sorted(tuple(x) for x in sequence.chunk_utterances(u, ms).collect())
        got = sorted(tuple(x) for x in sequence.chunk_by_jumps(u, ms, block=1).collect())  # blocks as short as a chunk may be long
        assert got == want and want[-1][0] == (3 if any(x[0] == 3 and (x[5] or "").strip() for x in rows) else 2)
    assert sequence.chunk_by_jumps(u.limit(0)).collect() == []
