"""Removal of repeated byte strings by a distributed suffix array.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (at a smaller document id, or earlier in the document).
Sorting every suffix of the corpus would move each byte many times, so the suffixes are first dealt out such that equal
strings meet: each start of a LENGTH-byte string has an anchor, the place of the least hash of K bytes within the string, which
depends on the string alone. The starts that share an anchor are a run; its extent is the bytes its strings cover.

1. Documents that repeat an earlier one byte for byte are set aside: all of their strings start earlier.
2. One row for each run; those that repeat an earlier one of their batch are known at once. The others are dealt and sorted by the hash of the anchor's K bytes, then of the extent. A run whose extent occurred
   earlier is a repeat as a whole; the first of its extent is open if other extents share its anchor, else it is alone.
3. The open runs' bytes are dealt by 70 bytes around the anchor, but for those that share these with no other run. In each task a suffix array (difference cover modulo 3: triples,
   names, recursion, merge) is built over them in blocks of whole keys, neighbours are compared over LENGTH bytes, and of each
   class of equal strings all but the earliest are repeats. (The strings of a key with more than HOT_ROWS rows are dealt one by one instead.)
4. Repeats come back to their documents as ranges, and the covered bytes are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm._store import BROADCAST_ROWS, drop_table, materialise, sent
from parley.llm._text import buffers, prefix_hash, slices, span_hash
from parley.llm.suffix_array import equal_neighbours, suffix_array

LENGTH, K = 100, 40
#: Half the room for the anchor: a string holds the HALF bytes before its anchor, or the HALF bytes after it.
HALF = (LENGTH - K) // 2
#: Bits of an anchor's sort key that hold its place, the others hold its hash; a Spark string has under 2**31 bytes.
PLACE_BITS = 31
#: Rows of one key that one task takes; the strings of a key with more are dealt one by one.
HOT_ROWS = 1_000
#: Bytes of runs that one suffix array is built over, about; more only where a single key has more.
BLOCK_BYTES = 1 << 18
NULL_ID = -(1 << 63)
RUN = "fp long, extent long, doc_id long, of long, a int, n int, later boolean"
RANGE = "doc_id long, of long, a int, n int"


def anchors(data: np.ndarray, offs: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs in some texts: text, first start (from the text's start), number of starts, hash of the anchor, hash of the extent."""
    n, window = len(data), LENGTH - K + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none
    places = np.arange(n - K + 1)
    low = np.uint64((1 << PLACE_BITS) - 1)
    if n > int(low):
        raise ValueError(f"a text of {n} bytes is over the {int(low)} that anchors can be told apart in")
    key = (span_hash(p, places, places + K) & ~low) | places.astype(np.uint64)
    least, width = key, 1
    while 2 * width <= window:  # least of each 2, 4, ... then of the whole window, as two overlapping ones
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    at = (least & low).astype(np.int64)  # the anchor of the string at each place
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(at)]
    starts = np.flatnonzero(np.arange(len(at)) + LENGTH <= offs[1:][doc])
    if not len(starts):
        return none, none, none, none, none
    at, doc = at[starts], doc[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(starts)))
    a, at, doc = starts[first], at[first], doc[first]
    return doc, a - offs[doc], count, at - offs[doc], span_hash(p, a, a + count - 1 + LENGTH)


def _runs(docs: DataFrame) -> DataFrame:
    """One row for each run. later: the batch itself holds an earlier run of that extent, so it is a repeat and need not meet others."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, of, got = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
            for lo, _, data, offs in slices(batch.column(2)):
                p = prefix_hash(data)
                doc, a, count, at, extent = anchors(data, offs, p)
                fp = span_hash(p, at + offs[doc], at + offs[doc] + K)
                got.append((fp.view(np.int64), extent.view(np.int64), lo + doc, a.astype(np.int32), count.astype(np.int32)))
            if not got:
                continue
            fp, extent, doc, a, count = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((a, ids[doc], extent, fp))
            fp, extent, doc, a, count = (x[order] for x in (fp, extent, doc, a, count))
            fresh = np.ones(len(fp), bool)
            fresh[1:] = (fp[1:] != fp[:-1]) | (extent[1:] != extent[:-1])
            own = np.maximum.accumulate(np.where(fresh, np.arange(len(fp)), 0))
            later = (ids[doc] != ids[doc[own]]) | (a != a[own])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fp, extent, ids[doc], of[doc], a, count, later)], names=["fp", "extent", "doc_id", "of", "a", "n", "later"])

    return docs.select("doc_id", "of", "data").mapInArrow(find, RUN)


def _judge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by later, fp, extent, doc_id, a. Keeps repeats (open: false) and first ones of an extent whose anchor others share (open: true)."""
    names = ["doc_id", "of", "a", "n", "open"]
    held: list | None = None  # the first run of the current anchor's first extent, until another extent follows
    last = first = None  # (fp, extent) of the row before, and its first row's (doc_id, a)
    many = False
    for batch in batches:
        if not batch.num_rows:
            continue
        known = batch.column(6).to_numpy(zero_copy_only=False)
        if known.any():
            yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(batch.column(6)) for i in range(2, 6)), pa.array(np.zeros(int(known.sum()), bool))], names=names)
            batch = batch.filter(pa.array(~known))
            if not batch.num_rows:
                continue
        fp, ex, doc, of, a, n = (batch.column(i).to_numpy() for i in range(6))
        new_fp, new_ex = np.ones(len(fp), bool), np.ones(len(fp), bool)
        new_fp[1:] = fp[1:] != fp[:-1]
        new_ex[1:] = new_fp[1:] | (ex[1:] != ex[:-1])
        new_fp[0] = last is None or last[0] != fp[0]
        new_ex[0] = new_fp[0] or last[1] != ex[0]
        # the first row of each extent; that of the one carried over comes from before
        owner = np.maximum.accumulate(np.where(new_ex, np.arange(len(fp)), -1))
        own_doc, own_a = (np.where(owner >= 0, x[owner], first[i] if first else 0) for i, x in enumerate((doc, a)))
        repeat = ~new_ex & ((doc != own_doc) | (a != own_a))
        # extents of each anchor so far, within the batch and before it
        group = np.cumsum(new_fp)
        extents = np.bincount(group, weights=new_ex, minlength=group[-1] + 1)
        tail = group == group[-1]
        shared = (extents > 1)[group]
        if not new_fp[0] and new_ex[group == 0].any():  # more extents of the anchor carried over
            shared |= group == 0
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(held, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], names=names)
            held, many = None, True
        elif not new_fp[0] and many:
            shared |= group == 0
        open_ = new_ex & shared
        keep = repeat | open_
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (doc, of, a, n, open_)], names=names)
        if new_fp.any():  # the anchor that the batch ends in may go on
            i = int(np.flatnonzero(tail & new_ex)[0])
            many = bool(shared[-1])
            held = None if many else [int(doc[i]), int(of[i]), int(a[i]), int(n[i]), True]
        last = (fp[-1], ex[-1])
        first = (own_doc[-1], own_a[-1])


def _texts_of_open(docs: DataFrame) -> DataFrame:
    """docs: doc_id, of, data, runs (array of a, n). The bytes of each run, cut in two by where its anchor stands: key, doc_id, of, a, n, bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, of, raw, runs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                p = prefix_hash(np.frombuffer(raw, np.uint8))
                a, n = (np.array([r[c] for r in runs], np.int64) for c in ("a", "n"))
                at = _anchor_of(p, a)
                # starts up to at - HALF hold the HALF bytes before the anchor, later ones those after it
                mid = np.clip(at - HALF + 1, a, a + n)
                lo, hi, x = np.concatenate([a, mid]), np.concatenate([mid, a + n]), np.concatenate([at - HALF, at])
                some = np.flatnonzero(lo < hi)
                lo, hi, x = lo[some], hi[some], x[some]
                out[0] += span_hash(p, x, x + K + HALF).view(np.int64).tolist()
                out[1] += [doc_id] * len(lo)
                out[2] += [of] * len(lo)
                out[3] += lo.tolist()
                out[4] += (hi - lo).tolist()
                out[5] += [raw[i : j - 1 + LENGTH] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names=["key", "doc_id", "of", "a", "n", "bytes"])

    return docs.select("doc_id", "of", "data", "runs").mapInArrow(cut, "key long, doc_id long, of long, a int, n int, bytes binary")


def _anchor_of(p: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The anchors of the strings that start at a, found as anchors() does."""
    places = a[:, None] + np.arange(LENGTH - K + 1)[None, :]
    h = span_hash(p, places.ravel(), places.ravel() + K).reshape(places.shape) >> np.uint64(PLACE_BITS)
    return a + np.argmin(h, axis=1)


def _repeats(doc: np.ndarray, of: np.ndarray, a: np.ndarray, n: np.ndarray, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and starts (from the row's own first) of the strings that an earlier one equals."""
    order = suffix_array(data.astype(np.int64) + 1, LENGTH)
    row = np.repeat(np.arange(len(doc)), np.diff(offs))
    start = np.arange(len(data)) - offs[row]
    order = order[start[order] < n[row[order]]]
    cls = np.concatenate([[0], np.cumsum(~equal_neighbours(data, order, LENGTH))]) if len(order) else order
    r, s = row[order], start[order]
    pos = a[r] + s
    sort = np.lexsort((pos, doc[r], cls))
    cls, r, s, pos = cls[sort], r[sort], s[sort], pos[sort]
    head = np.ones(len(cls), bool)
    head[1:] = cls[1:] != cls[:-1]
    h = np.maximum.accumulate(np.where(head, np.arange(len(cls)), 0))
    later = (doc[r] != doc[r[h]]) | (pos != pos[h])
    return r[later], s[later]


def _judge_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key. Ranges of starts whose string starts earlier too."""

    def ranges(t: pa.Table) -> pa.RecordBatch:
        doc, of, a, n = (t.column(c).to_numpy() for c in ("doc_id", "of", "a", "n"))
        data, offs = buffers(t.column("bytes"))
        r, s = _repeats(doc, of, a.astype(np.int64), n, data, offs)
        o = np.lexsort((s, r))
        r, s = r[o], s[o]
        fresh = np.ones(len(r), bool)
        fresh[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)
        first = np.flatnonzero(fresh)
        count = np.diff(np.append(first, len(r)))
        r, s = r[first], s[first]
        return pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(of[r]), pa.array((a[r] + s).astype(np.int32)), pa.array(count.astype(np.int32))], names=["doc_id", "of", "a", "n"])

    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.table(batch))
        size += batch.column(5).nbytes
        if size >= BLOCK_BYTES:
            t = pa.concat_tables(held).combine_chunks()
            key = t.column("key").to_numpy()
            ends = np.flatnonzero(key[1:] != key[:-1]) + 1  # where a new key begins
            offs = buffers(t.column("bytes"))[1]
            done = 0
            while True:
                fits = ends[(ends > done)]
                if not len(fits):
                    break
                stop = fits[np.minimum(np.searchsorted(offs[fits], offs[done] + BLOCK_BYTES), len(fits) - 1)]
                if offs[-1] - offs[done] < BLOCK_BYTES:
                    break
                yield ranges(t.slice(done, stop - done))
                done = int(stop)
            held = [t.slice(done)]
            size = int(offs[-1] - offs[done])
    if held:
        yield ranges(pa.concat_tables(held).combine_chunks())


def _judge_hot(texts: DataFrame) -> DataFrame:
    """As _judge_open, for keys with too many rows for one task: each string is a row of its own, and its earliest place is found by aggregation. Strings
    are compared byte by byte here too."""
    each = texts.select("doc_id", "of", "a", "bytes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
    each = materialise(each.select("doc_id", "of", (F.col("a") + F.col("s")).alias("a"), F.expr(f"substring(bytes, s + 1, {LENGTH})").alias("string")), "suffix-strings")
    first = materialise(each.groupBy("string").agg(F.min(F.struct("doc_id", "a")).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k"), "suffix-first")
    return each.join(first, "string").where("doc_id <> first.doc_id or a <> first.a").select("doc_id", "of", "a", F.lit(1).alias("n"))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, of, data, copy, ranges: n_bytes, n_removed, n_spans, kept."""
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        for raw, copy, ranges in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            n = len(raw)
            if copy and n >= LENGTH:
                row = (n, n, 1, b"")
            elif not ranges:
                row = (n, 0, 0, raw)
            else:
                a = np.array([r["a"] for r in ranges], np.int64)
                e = a + np.array([r["n"] for r in ranges], np.int64) - 1 + LENGTH
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, a, 1)
                np.add.at(edge, e, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                row = (n, int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes())
            for o, v in zip(out, row, strict=True):
                o.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _sent(ids: DataFrame) -> DataFrame:
    return sent(ids, BROADCAST_ROWS)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes).

    Texts are taken as UTF-8 bytes, null as empty; strings never cross documents and are judged on the input. Rows that share an id: neither
    is earlier than the other where starts are equal, so equal rows both stay. A null id comes first. Anchors, extents and
    equal documents are told apart by hashes (128 bits together); strings within a task are compared byte by byte.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("data"))
    hashed = materialise(rows.select("doc_id", F.xxhash64("data").alias("h1"), F.xxhash64(F.lit(1), "data").alias("h2")), "suffix-documents")
    # documents that repeat an earlier one; ids that several different rows share
    firsts = hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    firsts = materialise(firsts, "suffix-firsts")
    copies = materialise(hashed.join(firsts, ["h1", "h2"]).where("doc_id > first").select("doc_id", F.col("h1").alias("copy_h1")).distinct(), "suffix-copies")
    shared = materialise(hashed.groupBy("doc_id").agg(F.countDistinct("h1", "h2").alias("k")).where("k > 1").select("doc_id", F.lit(True).alias("shared")), "suffix-shared")
    h1 = F.xxhash64("data")
    named = rows.join(_sent(shared), "doc_id", "left").select("doc_id", F.when(F.col("shared"), h1).otherwise(F.lit(0)).alias("of"), "data")
    sent_copies = _sent(copies)
    named = named.withColumn("h1", h1).join(sent_copies.withColumn("copy", F.lit(True)).withColumnRenamed("copy_h1", "h1"), ["doc_id", "h1"], "left").drop("h1")
    original = named.where(F.col("copy").isNull() & (F.octet_length("data") >= LENGTH))

    deal = F.when(F.col("later"), F.xxhash64("doc_id", "a")).otherwise(F.col("fp"))
    runs = _runs(original).repartition(partitions, deal).sortWithinPartitions("later", "fp", "extent", "doc_id", "a").mapInArrow(_judge_runs, f"{RANGE}, open boolean")
    runs = materialise(runs, "suffix-runs")
    opened = runs.where("open").groupBy("doc_id", "of").agg(F.collect_list(F.struct("a", "n")).alias("runs"))
    texts = materialise(_texts_of_open(original.join(opened, ["doc_id", "of"]).select("doc_id", "of", "data", "runs")), "suffix-open")
    # a key that one row alone has holds no string twice: within a row equal strings would have their anchors at different places
    keys = materialise(texts.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "suffix-keys")
    shared = texts.join(_sent(keys), "key")
    found = shared.where(F.col("k") <= HOT_ROWS).drop("k").repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(_judge_open, RANGE)
    if not keys.where(F.col("k") > HOT_ROWS).isEmpty():
        found = found.unionByName(_judge_hot(shared.where(F.col("k") > HOT_ROWS).drop("k")))
    ranges = materialise(runs.where("not open").select("doc_id", "of", "a", "n").unionByName(found), "suffix-ranges")
    for spent in (hashed, firsts, runs, texts, keys):
        drop_table(spent)
    by_doc = ranges.groupBy("doc_id", "of").agg(F.collect_list(F.struct("a", "n")).alias("ranges"))
    out = named.join(by_doc, ["doc_id", "of"], "left").select("doc_id", "data", F.coalesce("copy", F.lit(False)).alias("copy"), "ranges")
    out = out.mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn(id_col, F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))).select(id_col, "n_bytes", "n_removed", "n_spans", "kept")


def repeats_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """remove_repeats() in figures, with kept_sha256 in place of the bytes."""
    got = remove_repeats(docs, id_col, text_col)
    return got.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

