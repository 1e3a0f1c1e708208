"""Benchmark decontamination by winnowing.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased. Every benchmark item gives its windows of
WINDOW words (a shorter item is one window). A window's fingerprint is the least of the hashes of its K-word sequences (of a short item the hash of all
words), so two texts that share a window share its fingerprint, and a text has few different ones.

Documents and items are fingerprinted alike, and the windows of documents whose fingerprint an item has are found by an equi-join. The hits are then
extended: such a window is compared with the items' windows word by word, and all words within windows that occur are marked.

Before the join a Bloom filter of the items' fingerprints, of fixed size at most, tells the tasks what cannot match; what it lets through by mistake, the join drops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm._store import BROADCAST_ROWS, materialise
from parley.llm._text import LOWER, give_back, mix, prefix_hash, runs, sequence_hash, slices, span_hash

WINDOW, K = 13, 8
#: Bits of the Bloom filter for one fingerprint, log2 of its bits at least and at most (16 MB), and places tested.
BLOOM_BITS, BLOOM_LEAST, BLOOM_MOST, PROBES = 24, 13, 27, 4
#: Parts that the filter is put together in.
PARTS = 16
U64 = np.uint64
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 256)]] = True
WINDOWS = "fp long, n int, words binary, item string"
NEAR = pa.list_(pa.struct([("fp", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("words", pa.binary())]))


def fingerprints(h: np.ndarray, window: int, k: int) -> np.ndarray:
    """For each window of words, given by their hashes, the least hash of its k-word sequences."""
    g = sequence_hash(h, k)
    w = window - k + 1
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, U64)
    least = g[:n].copy()
    for i in range(1, w):
        np.minimum(least, g[i : i + n], out=least)
    return least


def words_of(raw: bytes, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    return [raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]


def _item_windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """items: item, text. A row for each window: fp, n (words), words (joined by spaces), item."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, _, data, offs in slices(batch.column(1)):
                data = LOWER[data]
                start, end, first = runs(IS_WORD[data], offs)
                h, raw = span_hash(prefix_hash(data), start, end), data.tobytes()
                for d in range(len(offs) - 1):
                    s, e = int(first[d]), int(first[d + 1])
                    n = min(e - s, window)
                    if not n:
                        continue
                    fp = fingerprints(h[s:e], window, k) if n == window else sequence_hash(h[s:e], n)
                    words = words_of(raw, start[s:e], end[s:e])
                    for at in range(0, len(fp), 10_000):
                        part = range(at, min(at + 10_000, len(fp)))
                        yield pa.RecordBatch.from_arrays([pa.array(fp[at : at + 10_000].view(np.int64)), pa.array([n] * len(part), pa.int32()), pa.array([b" ".join(words[i : i + n]) for i in part], pa.binary()), pa.array([names[lo + d]] * len(part), pa.string())], names=["fp", "n", "words", "item"])

    return items.mapInArrow(make, WINDOWS)


def _places(fp: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(fp + U64(0x9E3779B97F4A7C15) * U64(i + 1)) >> U64(64 - bits)).astype(np.int64) for i in range(PROBES)]


def bloom(prints: DataFrame, rows: int) -> np.ndarray:
    """prints: fp. A bit set as bytes of 8, filled in tasks part by part; at most 2 ** BLOOM_MOST bits come to the driver."""
    bits = int(np.clip(int(rows * BLOOM_BITS).bit_length(), BLOOM_LEAST, BLOOM_MOST))
    size = (1 << bits) // 8 // PARTS

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, bool)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy().view(U64), bits):
                own[at] = True
        packed = np.packbits(own).reshape(PARTS, size)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in packed], pa.binary())], names=["part", "bits"])

    def join(table: pa.Table) -> pa.Table:
        out = np.zeros(size, np.uint8)
        for c in table.column("bits"):
            out |= np.frombuffer(c.as_buffer(), np.uint8)
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros((PARTS, size), np.uint8)
    few = prints.repartition(max(1, min(64, rows // 1_000_000)))  # each task makes a whole set
    for r in few.mapInArrow(fill, "part int, bits binary").groupBy("part").applyInArrow(join, "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


def _among(fp: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places in fp that hold a fingerprint which may be known."""
    bits = len(known).bit_length() + 2
    at = np.arange(len(fp))
    for i in range(PROBES):
        slot = mix(fp[at] + U64(0x9E3779B97F4A7C15) * U64(i + 1)) >> U64(64 - bits)
        at = at[(known[(slot >> U64(3)).astype(np.int64)] >> (U64(7) - (slot & U64(7))).astype(np.uint8)) & 1 > 0]
    return at


def _candidates(rows: DataFrame, known: np.ndarray, lengths: list[int], window: int, k: int) -> DataFrame:
    """rows: doc_id, row, text. doc_id, row, n_words, near: the windows whose fingerprint may be an item's."""
    shared = rows.sparkSession.sparkContext.broadcast(known)  # 2 ** BLOOM_MOST bits at most

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            near: list[list] = [[] for _ in range(batch.num_rows)]
            for lo, hi, data, offs in slices(batch.column(2)):
                data = LOWER[data]
                start, end, first = runs(IS_WORD[data], offs)
                n_words[lo:hi] = np.diff(first)
                h, raw = span_hash(prefix_hash(data), start, end), None
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                for n in lengths:
                    fp = fingerprints(h, window, k) if n == window else sequence_hash(h, n)
                    at = _among(fp, shared.value)
                    at = at[doc[at] == doc[at + n - 1]] if len(at) else at  # whole windows of one text
                    if len(at) and raw is None:
                        raw = data.tobytes()
                    for i, d, f in zip(at.tolist(), doc[at].tolist(), fp[at].view(np.int64).tolist(), strict=True):
                        near[lo + d].append((f, i - int(first[d]), n, b" ".join(words_of(raw, start[i : i + n], end[i : i + n]))))
            flat = [x for xs in near for x in xs]
            kinds = [pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in near])]), pa.int32()), pa.StructArray.from_arrays(kinds, names=["fp", "start", "n", "words"]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(n_words), lists.cast(NEAR)], names=["doc_id", "row", "n_words", "near"])
        give_back()

    return rows.mapInArrow(look, "doc_id long, row long, n_words long, near array<struct<fp:long,start:int,n:int,words:binary>>")


def _small(table: DataFrame, weight: str = "1", rows: int | None = None) -> DataFrame:
    """table, to be sent to every task if the sum of weight over its rows shows that it is small; else it is shuffled like any other."""
    most = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(table) if (table.agg(F.sum(F.expr(weight)).alias("w")).first()["w"] or 0) <= most else table


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans (merged word spans, end exclusive) and items (ids, sorted as strings).

    Null texts have no words; items without words never occur. A null item id hits words but is not listed; a null document id is returned
    as null. Rows that share a document id are judged apart. Other columns of either table are ignored.
    """
    items = materialise(_item_windows(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")), window, k), "bench-windows")
    prints = materialise(items.select("fp").distinct(), "bench-prints")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # window at most
    known = bloom(prints, prints.count())
    windows = materialise(items.groupBy("words").agg(F.collect_set("item").alias("items")), "bench-by-window")

    # the table holds each row's own number, so that it is the same wherever it is read
    numbered = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    rows = materialise(_candidates(numbered, known, lengths, window, k), "bench-candidates")
    near = rows.where(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", "x.*")
    met = near.join(_small(prints), "fp", "left_semi")
    hits = met.join(_small(windows, "1 + size(items)"), "words").select("row", F.struct("start", (F.col("start") + F.col("n")).alias("end")).alias("span"), "items")
    # windows in a row mostly belong to the same items
    by_items = hits.groupBy("row", "items").agg(F.collect_set("span").alias("spans"))
    by_row = by_items.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x)))
    spans = F.aggregate("spans", F.array().cast("array<struct<start:int,end:int>>"), step)
    found = materialise(by_row.select("row", spans.alias("spans"), "items"), "bench-hits")
    out = rows.select("row", "doc_id", "n_words").join(_small(found, "1 + size(spans) + size(items)"), "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """contamination() in figures: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a twentieth of the words or more is hit)."""
    got = contamination(docs, benchmark, **columns)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return got.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")).withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))
