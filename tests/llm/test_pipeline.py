"""run() against plain Python over the same rows."""

import hashlib

import numpy as np

import corpus_pipeline
from parley.llm import mixing, quality, queries
from tests.conftest import SF
from tests.llm import brute


def quality_kept(rows):
    """The verdicts, from figures by plain Python, by a plain EM over single documents."""
    f = {k: np.array(v, float) for k, v in zip(quality.FIGURES, zip(*(brute.op8_figures(r[1]) for r in rows), strict=True), strict=True)}
    n, lines = np.maximum(f["n_words"], 1), np.maximum(f["n_lines"], 1)
    some = f["n_words"] >= 20
    vote = lambda bad, good=None: np.where((some if good is not None else True) & bad, -1, np.where(some & (good if good is not None else False), 1, 0))
    mean, sym, rep, dup = f["word_chars"] / n, f["n_symbols"] / n, f["n_repeat_words"] / n, f["n_dup_lines"] / lines
    upper, short, let, marks = f["n_upper"] / np.maximum(f["n_letters"], 1), f["n_short"] / n, f["n_lettered"] / n, f["n_marks"] / np.maximum(f["word_chars"], 1)
    v = np.stack([vote(f["n_words"] < 20), vote(rep > 0.3), vote((dup > 0.3) & (f["n_lines"] >= 4)), vote((upper > 0.5) & (f["n_letters"] >= 50)), vote(sym > 0.1, sym < 0.02), vote(let < 0.8, let > 0.9), vote(marks > 0.25, marks < 0.1), vote((mean < 3) | (mean > 10), (mean >= 3.5) & (mean <= 7)), vote((short < 0.03) | (short > 0.6), (short > 0.1) & (short < 0.5))], 1)
    share, acc = 0.8, np.full(v.shape[1], 0.8)
    for _ in range(200):
        post = 1 / (1 + np.exp(-(np.log(share / (1 - share)) + v @ np.log(acc / (1 - acc)))))
        hits = (post[:, None] * (v > 0) + (1 - post)[:, None] * (v < 0)).sum(0)
        acc = np.clip((hits + 16) / ((v != 0).sum(0) + 20), 0.55, 0.99)
        share = np.clip((post.sum() + 16) / (len(v) + 20), 0.05, 0.95)
    failed = (f["n_words"] < 20) | (100 * f["n_repeat_words"] > 30 * f["n_words"])
    post = 1 / (1 + np.exp(-(np.log(share / (1 - share)) + v @ np.log(acc / (1 - acc)))))
    return [r for r, ok in zip(rows, ~failed & (post >= 0.5), strict=True) if ok]


def contaminated(text, items):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(brute.LOWER))
    windows = set()
    for t in items:
        w = words(t)
        if w:
            n = min(13, len(w))
            windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    w, hit = words(text), set()
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
    return len(hit) > 0 and 20 * len(hit) >= len(w)


def mixed(rows):
    """rows repeated as a plain weighted fair queue serves them."""
    size = {r[0]: len(brute.WORD.findall(r[1] or "")) for r in rows}
    sources = sorted({r[3] for r in rows})
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in sources}
    entries = []
    for k, s in enumerate(sources):
        upto = 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            upto += size[r[0]]
            entries += [((e * total[s] + upto) / mixing.WEIGHTS[k % 3], hashlib.md5(str(r[0]).encode()).hexdigest(), s, e, r) for e in range(3) if size[r[0]]]
    out, used = [], 0
    for e in sorted(entries, key=lambda e: e[:4]):
        used += size[e[4][0]]
        if used > sum(total.values()):
            break
        out.append(e[4])
    return out


def test_run_against_plain_python(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert docs.columns == corpus_pipeline.COLUMNS
    rows = [tuple(r) for r in docs.collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = quality_kept(rows)
    comp = brute.op2([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if comp[r[0]][1] == r[0]]
    rows = [r for r in rows if not contaminated(r[1], items)]
    rows = mixed(rows)
    want = brute.op4([(r[0], r[1]) for r in rows], Tokenizer.from_file(queries.tokenizer_path()))
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1])
    assert got == want and len(want) > 50


def test_stages_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "a", 0), (2, "word " * 50, "en", None, 1), (2, "word " * 50, "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    # of the two copies one stays, and only it has words to be taken
    for start, counts in ((docs, [3, 3, 1]), (docs.limit(0), [0, 0, 0])):
        now, left = start, []
        for name, stage in corpus_pipeline.STAGES[1:]:
            now = stage(spark, now, SF)
            if name != "token_output":
                assert now.columns == docs.columns
                left.append(now.count())
        assert left == counts and [(r.doc_id, r.start) for r in now.collect()] == ([(2, 0)] if counts[0] else [])
    assert corpus_pipeline.quality_rules(spark, docs, SF).count() == 0
