"""Sharding, URL filter, line dedup, decontamination and mixing: odd rows, parameters, and the SQL of the registered queries."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from parley.llm import decontaminate, line_dedup, mixing, queries, sharding, urls
from parley.llm.graph import components
from tests.conftest import SF
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    r = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert Counter(tuple(x) for x in got.select(*names).collect()) == Counter(r.fetchall())
    assert sorted(names) == sorted(got.columns)


def docs_of(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns).repartition(3)


def test_shards_fit(spark):
    rows = [(i, "x" * (i * 37 % 500)) for i in range(300)] + [(None, "y" * 90), (7, None), (1000, "z" * 5000)] + [(5, "same" * 20)] * 60
    got = sharding.shards(docs_of(spark, [(*r, "s", 1) for r in rows], "doc_id long, text string, shard string, depth int"), limit=1500).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.depth == len(r.shard)
    for s, rs in by.items():
        size = sum(r.n_bytes for r in rs)
        assert {(r.shard_bytes, r.shard_rows) for r in rs} == {(size, len(rs))}
        assert size <= 1500 or len(rs) == 1
        assert not any(o != s and o.startswith(s) for o in by)  # a prefix code: each hash has one shard
        if len(s) > sharding.START_BITS:  # split only where it was needed
            assert sum(r.n_bytes for r in got if r.shard.startswith(s[:-1])) > 1500
    again = sharding.shards(docs_of(spark, rows).coalesce(1).sortWithinPartitions("doc_id"), limit=1500).select("doc_id", "shard").where("length(shard) <= 48")
    assert Counter(map(tuple, again.collect())) == Counter((r.doc_id, r.shard) for r in got if len(r.shard) <= 48)  # the keys' own bits do not depend on places
    assert sharding.shards(docs_of(spark, rows).limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    docs = docs_of(spark, [(i, "x" * 100) for i in range(50)])
    shards = sharding.write_shards(docs, f"file://{tmp_path}/s", limit=1000)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == 50 and back.select("shard").distinct().count() == shards.count() >= 5


def plain_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(brute.LOWER)
    fit = [(len(h + p), len(h), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[2]) if fit else (host, path, None, "allow")


def test_url_filter(spark, monkeypatch):
    rules = [*urls.RULES, ("block", "a.b", ""), ("allow", "b", "/x"), ("block", "x.b", "/x"), ("block", "b", "/x")]
    seen = [None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://Www.EXAMPLE.com/en/1?q#f", "http://example.com/en/", "http://xexample.com/en/", "http://a.b", "http://c.a.b?x", "http://b/x", "http://x.b/xy", "ftp://é.net/es/", "x://net/fr/#", "http://e.net/\nfr", "http://.b/x", "a://b://c.com/y", "http://" + "a." * 3000 + "b/x", "http://com/" + "p" * 50_000]
    pages = spark.createDataFrame([(i % 7, u, 1) for i, u in enumerate(seen * 3)], "page_id long, url string, host int").repartition(4)
    want = Counter((i % 7, *plain_verdict(u, rules)) for i, u in enumerate(seen * 3))
    for bound in (200_000, 0):
        monkeypatch.setattr(urls, "BROADCAST_RULES", bound)
        got = urls.filter_urls(pages, urls.rule_table(spark, rules))
        assert Counter(map(tuple, got.collect())) == want
    assert urls.filter_urls(pages.limit(0), urls.rule_table(spark)).count() == 0
    assert {r.verdict for r in urls.filter_urls(pages, urls.rule_table(spark).limit(0)).collect()} == {"allow"}


def plain_lines(rows, least=20, docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(brute.LOWER)
    where = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            where[key(line)].add(i if i is not None else -(1 << 63))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        me = i if i is not None else -(1 << 63)
        kept = [x for x in lines if not (len(key(x)) >= least and len(where[key(x)]) >= docs and me != max(where[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 3, 9])
def test_line_dedup(spark, batches):
    a, b, c = "This is a line of over twenty", "Éine Zeile mit über zwanzig É", "  Short enough to stay  "
    rows = [(i, "\n".join(x for x in (a if i % 2 else a.upper() + " \t", f"own line number {i} of this text", b if i % 3 else "", c) for _ in range(1 + i % 2))) for i in range(1, 40)]
    rows += [(None, a), (None, None), (0, ""), (50, a), (50, b + "\n" + a), (50, a), (60, "\n\n"), (61, "x\n" * 3000 + a)]
    docs = docs_of(spark, [(*r, "z", "k") for r in rows], "doc_id long, text string, key string, gone string")
    got = line_dedup.dedup_lines(docs, batches=batches, fanout=2)
    assert Counter(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "text").collect())) == plain_lines(rows)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_store_over_deliveries(spark):
    store = line_dedup.LineRuns(spark, fanout=2)
    frame = lambda keys, d: spark.createDataFrame([(k.encode(), d) for k in keys], "key binary, doc_id long")
    for n, keys in enumerate(("ab", "bc", "cd", "a", "e")):
        assert {bytes(r.key) for r in store.new_pairs(frame(keys, 9 - n)).collect()} == {k.encode() for k in keys}
        store.add(frame(keys, 9 - n))
        assert store.new_pairs(frame(keys, 9 - n)).isEmpty()
    assert sum(len(x) for x in store.levels.values()) <= 3
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:  # what is stored is not shuffled again
        met = store.new_pairs(store.runs()[0])
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString() and met.isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    got = {bytes(r.key).decode(): (r.n_docs, r.keeper) for r in store.keys().collect()}
    store.close()
    assert not store.runs()
    assert got == {"a": (2, 9), "b": (2, 9), "c": (2, 8), "d": (1, 7), "e": (1, 5)}


def plain_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(brute.LOWER))
    w, hit, names = words(text), set(), set()
    for name, t in items:
        x = words(t)
        n = min(13, len(x))
        for win in {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == win:
                    hit |= set(range(i, i + n))
                    names.add(name)
    return len(w), len(hit), sorted(x for x in names if x is not None)


def test_decontamination(spark, monkeypatch):
    import random

    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    items = [(10, " ".join(base[:30])), (9, "Über, short item!"), (2, ""), (3, None), (4, "one"), (5, " ".join(base[5:18])), (5, " ".join(base[40:60])), (None, "x1 x2 x3")]
    rows = [(1, None), (2, ""), (3, "one"), (4, "xx one, yy"), (5, " ".join(base[:12])), (6, " ".join(base[:13])), (7, "a " + " ".join(base[3:50]).upper() + "."), (8, "über short; ITEM one"), (None, "x1 x2 x3"), (9, "x1 x2 x3"), (9, " ".join(base[5:18]) + " q " * 500)]
    rows += [(100 + i, " ".join(rng.choice(base) for _ in range(rng.randrange(40))) + " " + " ".join(base[(s := rng.randrange(45)) : s + rng.randrange(20)])) for i in range(80)]
    docs = docs_of(spark, [(*r, "i") for r in rows], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, row int")
    want = Counter()
    for i, t in rows:
        n, h, names = plain_hits(t, items)
        want[i, n, h, len(names), brute.sha(",".join(sorted(map(str, names)))), h > 0 and 20 * h >= n] += 1
    assert Counter(map(tuple, decontaminate.contamination_report(docs, bench).collect())) == want
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "BLOOM_MOST", 7)  # lets nearly all through
    monkeypatch.setattr(decontaminate, "BLOOM_LEAST", 7)
    assert Counter(map(tuple, decontaminate.contamination_report(docs, bench).collect())) == want
    assert decontaminate.contamination_report(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination_report(docs, bench.limit(0)).collect()} == {0}


def test_mixing_odd_rows(spark, monkeypatch):
    rows = [(i, "w " * (1 + i * 7 % 40), ["a", "b", "c", None, ""][i % 5] if i % 3 else "a") for i in range(400)] + [(None, "x y", "a"), (1, None, "b"), (2, "", None), (7, "q r s", "d"), (7, "q r s", "d")]
    docs = docs_of(spark, [(*r, 5, "t") for r in rows], "doc_id long, text string, source string, size int, target string")
    first = mixing.mix(docs)
    got = first.collect()
    assert len(got) == len(rows) and first.columns == ["doc_id", "size", "source_size", "target", "taken"]
    total = sum(r["size"] for r in got)
    assert total - 40 <= sum(r.taken for r in got) <= total
    assert all(r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0) for r in got)
    by = Counter()
    for r in got:
        by[r.source_size, round(r.target, 6)] += r.taken
    # each source misses by less than a document, and by its part of what the others miss
    assert all(abs(t - taken) <= 40 * 3 for (_, t), taken in by.items()), by
    # the targets: shares by weight, stopped at three times the source, the excess reshared
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted((s for s in size if s is not None), key=lambda s: s.encode("utf-32-be")) + [None])}
    target, free = {}, set(size)
    while True:
        left = total - sum(target.values())
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * size[s]}
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: 3 * size[s] for s in over}
        free -= over
    assert {(size[s], round(t, 6)) for s, t in target.items()} == set(by)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    monkeypatch.setattr(mixing, "BINS", 7)
    assert Counter(map(tuple, mixing.mix(docs.repartition(1)).collect())) == Counter(map(tuple, got))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(docs.where("text is null")).collect()} == {0}


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)] + [(200, x) for x in range(201, 260)] + [(230, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100, **dict.fromkeys(range(200, 260), 200), 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_md5_bits(spark):
    assert spark.range(1).select(sharding.hash_number(F.lit(5)).alias("b")).first().b == int(hashlib.md5(b"5").hexdigest()[:12], 16)
