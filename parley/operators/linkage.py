"""Average linkage of meetings of any size.

A large meeting's clusters are merged in rounds of reciprocal nearest neighbours, which average linkage allows to be merged in any order: each round deals
the clusters into blocks, multiplies every pair of blocks once, in a group of its own, and merges the pairs that are nearest to each other. Of a cluster its
size and the sum of its vectors are kept, as the mean distance of two clusters is 1 less the product of their sums over their sizes. Once few
clusters are left, or rounds merge few of them, one task ends the meeting by lists of near clusters. What it gets is the list of merges, from which every number of clusters is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.numbering import dropped, kept, new_folder, stored
from parley.operators.vectors import LEAST_DISTANCE, LEAST_MEMBERS, LEAST_SHARE, LEAST_SILHOUETTE, NEAR_BEST, NEAR_BEST_MANY, chained_linkage, cut, listed_linkage, matrix

#: Clusters that one task ends, and clusters in one block.
LOCAL, BLOCK = 2_000, 2_000
#: Blocks of a meeting, as long as a block has at most WIDEST clusters; distances that a task holds at once.
BLOCKS, WIDEST, STRIP = 16, 20_000, 4_000_000
#: A round that merges under one in FEW of a meeting's clusters is the last one, if one task can end the meeting in time: with up to PATIENCE times the clusters. (Where large clusters take in
#: single rows one by one, few pairs are nearest to each other.) Up to CHAINED clusters a chain is faster than lists.
FEW, PATIENCE, CHAINED = 10, 100, 5_000
#: Rows that are judged at once.
PIECE = 20_000
MERGE = "meeting_id long, d double, i long, j long"


def _nearest(mx: np.ndarray, my: np.ndarray, cx: np.ndarray, cy: np.ndarray, same: bool, strip: int = STRIP) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For the clusters cx (ascending) with means mx the distance and the id of the nearest of cy with means my, and the other way round; the smaller id of equals. same: cx are cy, and a pair is looked
    at once, from its smaller id. strip distances are held at once; as strips of smaller ids come first, only what is less counts in a later one."""
    cols = np.full(len(cy), np.inf), np.zeros(len(cy), np.int64)
    rows = cols if same else (np.full(len(cx), np.inf), np.zeros(len(cx), np.int64))
    step = max(1, strip // len(cy))
    for lo in range(0, len(cx), step):
        x, from_ = cx[lo : lo + step], lo if same else 0
        d = mx[lo : lo + step] @ my[from_:].T
        np.subtract(1, d, out=d)
        if same:
            d[:, : len(d)][np.tri(len(d), dtype=bool)] = np.inf
        best, at = (c[from_:] for c in cols)
        least = d.min(0)
        less = np.flatnonzero(least < best)
        best[less], at[less] = least[less], x[np.ascontiguousarray(d[:, less].T).argmin(1)]
        best, at = (r[lo : lo + step] for r in rows)
        least, where = d.min(1), d.argmin(1)
        less = np.flatnonzero(least < best)
        best[less], at[less] = least[less], cy[from_ + where[less]]
    return rows, cols


def nearest(clusters: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each cluster (meeting_id, c, n, s) the nearest other of its meeting: meeting_id, c, d, other. Of equal distances the pair with the smaller ids
    comes first, for both of its clusters alike."""
    sizes = clusters.groupBy("meeting_id").agg(F.count("*").alias("size"))
    dealt = clusters.join(F.broadcast(sizes), "meeting_id") if sizes.count() < 100_000 else clusters.join(sizes, "meeting_id")
    width = F.least(F.lit(max(WIDEST, block)), F.greatest(F.lit(block), F.ceil(F.col("size") / BLOCKS)))
    blocks = F.ceil(F.col("size") / width).cast("int")
    own = F.pmod(F.xxhash64("c"), blocks).cast("int")
    dealt = dealt.select("meeting_id", "c", "n", "s", own.alias("own"), blocks.alias("blocks"))
    # each pair of blocks has a group: the smaller of the two on the left
    left = dealt.select(F.col("meeting_id").alias("m"), "c", "n", "s", F.col("own").alias("a"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("b"))
    right = dealt.select(F.col("meeting_id").alias("m"), *(F.col(x).alias(x) for x in "cns"), F.explode(F.sequence(F.lit(0), "own")).alias("a"), F.col("own").alias("b"))

    def pair(x: pa.Table, y: pa.Table) -> pa.Table:
        kinds = {"meeting_id": pa.int64(), "c": pa.int64(), "d": pa.float64(), "low": pa.int64(), "high": pa.int64()}
        if not x.num_rows or not y.num_rows:
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        meeting, same = x.column("m")[0].as_py(), x.column("a")[0].as_py() == x.column("b")[0].as_py()
        x, y = x.sort_by("c"), y.sort_by("c")
        cx, cy = x.column("c").to_numpy(), y.column("c").to_numpy()
        mx, my = (matrix(t.column("s")) / t.column("n").to_numpy()[:, None] for t in (x, y))
        rows, cols = _nearest(mx, my, cx, cy, same)
        out = []
        for own, (best, other) in ((cy, cols),) if same else ((cx, rows), (cy, cols)):
            ok = np.isfinite(best)
            out.append(pa.table({"meeting_id": pa.array(np.full(ok.sum(), meeting)), "c": own[ok], "d": best[ok], "low": np.minimum(own, other)[ok], "high": np.maximum(own, other)[ok]}))
        return pa.concat_tables(out)

    met = left.groupBy("m", "a", "b").cogroup(right.groupBy("m", "a", "b")).applyInArrow(pair, "meeting_id long, c long, d double, low long, high long")
    best = met.groupBy("meeting_id", "c").agg(F.min(F.struct("d", "low", "high")).alias("x"))
    return best.select("meeting_id", "c", "x.d", F.when(F.col("x.low") == F.col("c"), F.col("x.high")).otherwise(F.col("x.low")).alias("other"))


def merges(vectors: DataFrame, local: int = LOCAL, block: int = BLOCK) -> DataFrame:
    """vectors: meeting_id, idx, embedding (of length 1). All merges of all meetings: meeting_id, d (the distance), i, j (the smallest idx of either cluster),
    one fewer than the meeting has rows."""
    spark, slow, round_ = vectors.sparkSession, None, 0
    # each round's tables are made from those of the round before, and go with it; its merges stay, in a folder of their own
    folder = new_folder(spark)
    now = stored(vectors.select("meeting_id", F.col("idx").alias("c"), F.lit(1).cast("long").alias("n"), F.transform("embedding", lambda x: x.cast("double")).alias("s")))
    while True:
        sizes = now.groupBy("meeting_id").agg(F.count("*").alias("size"))
        large = sizes.where(F.col("size") > local)
        if slow is not None:
            large = large.join(slow, "meeting_id", "left").where(F.col("slow").isNull() | (F.col("size") > PATIENCE * local))
        large = stored(large.select("meeting_id", "size"))
        if large.isEmpty():
            dropped(large)
            break
        near = stored(nearest(now.join(large.select("meeting_id"), "meeting_id", "left_semi"), block))
        back = near.select("meeting_id", F.col("c").alias("other"), F.col("other").alias("c"))
        pairs = stored(near.join(back, ["meeting_id", "c", "other"]).where("c < other").select("meeting_id", "d", F.col("c").alias("i"), F.col("other").alias("j")), f"{folder}/round={round_}")
        if slow is not None:
            dropped(slow)
        slow = stored(large.join(pairs.groupBy("meeting_id").agg(F.count("*").alias("n")), "meeting_id").where(F.col("n") * FEW < F.col("size")).select("meeting_id", F.lit(True).alias("slow")))
        to = pairs.select("meeting_id", F.col("j").alias("c"), F.col("i").alias("into"))
        moved = now.join(to, ["meeting_id", "c"], "left").withColumn("c", F.coalesce("into", "c"))
        # two rows at most come together
        both = moved.groupBy("meeting_id", "c").agg(F.sum("n").alias("n"), F.collect_list("s").alias("ss"))
        add = F.aggregate(F.slice("ss", 2, 1), F.get("ss", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
        before, now, round_ = now, stored(both.select("meeting_id", "c", "n", add.alias("s"))), round_ + 1
        dropped(before, large, near)

    def end(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c")
        c = rows.c.to_numpy()
        got = (chained_linkage if len(c) <= CHAINED else listed_linkage)(np.stack(rows.s.to_numpy()), rows.n.to_numpy())
        return pd.DataFrame({"meeting_id": rows.meeting_id.iloc[0], "d": [m[0] for m in got], "i": [c[m[1]] for m in got], "j": [c[m[2]] for m in got]})

    rest = now.groupBy("meeting_id").applyInPandas(end, MERGE)
    return rest if not round_ else spark.read.schema(MERGE).parquet(folder).select(rest.columns).unionByName(rest)


def labels(vectors: DataFrame, made: DataFrame, most: int) -> DataFrame:
    """vectors with labels: for each number of clusters from 2 to most (or fewer, as there are rows) the label of the row. A meeting's merges, three numbers for
    each row, are cut in one task; its vectors stay where they are."""

    def one(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(known):
            return pd.DataFrame({"meeting_id": [], "idx": [], "labels": []})
        idx = np.sort(known.idx.to_numpy())
        rows = rows.sort_values(["d", "i", "j"])
        m = list(zip(rows.d, np.searchsorted(idx, rows.i), np.searchsorted(idx, rows.j), strict=True))
        cuts = np.stack([cut(m, len(idx), k) for k in range(2, min(most, len(idx)) + 1)] or [np.zeros(len(idx), int)])
        return pd.DataFrame({"meeting_id": known.meeting_id.iloc[0], "idx": idx, "labels": list(cuts.T.astype(np.int32))})

    found = made.groupBy("meeting_id").cogroup(vectors.select(F.col("meeting_id").alias("m"), "idx").withColumnRenamed("m", "meeting_id").groupBy("meeting_id")).applyInPandas(one, "meeting_id long, idx long, labels array<int>")
    return vectors.join(found, ["meeting_id", "idx"])


def sums(labelled: DataFrame) -> DataFrame:
    """meeting_id, n, sums: for each number of clusters, by label, the number and the sum of the vectors. labelled: meeting_id, embedding, labels."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m, meeting, cuts = matrix(batch.column(1)), batch.column(0).to_numpy(), batch.column(2).to_pylist()
            out = []
            for x in np.unique(meeting):
                of = np.flatnonzero(meeting == x)
                for k, own in enumerate(np.stack([cuts[i] for i in of]).T):
                    for label in np.unique(own):
                        at = of[own == label]
                        out.append((x, k, label, len(at), m[at].sum(0).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())))], names=["meeting_id", "k", "label", "n", "s"])

    got = labelled.select("meeting_id", "embedding", "labels").mapInArrow(part, "meeting_id long, k int, label int, n long, s array<double>")
    by = got.groupBy("meeting_id", "k", "label").agg(F.sum("n").alias("n"), F.collect_list("s").alias("ss"))
    whole = F.aggregate(F.slice("ss", 2, 1 << 30), F.get("ss", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return by.select("meeting_id", "k", "label", "n", whole.alias("s"))


def chosen(labelled: DataFrame) -> DataFrame:
    """meeting_id, k: which of the cuts is taken (0 stands for two clusters, and so on), -1 for one speaker. The largest that scores near the best, of those that
    are clean; the silhouette of each row needs its products with the sums of the labels alone."""
    told = kept(sums(labelled))
    pieces = told.where("k = 0").groupBy("meeting_id").agg(F.ceil(F.sum("n") / PIECE).cast("int").alias("pieces"))
    pieces = F.broadcast(pieces) if pieces.count() < 100_000 else pieces
    # a meeting's rows are dealt into pieces, and each piece gets the few dozen vectors of the meeting once
    dealt = labelled.join(pieces, "meeting_id").select("meeting_id", F.pmod(F.xxhash64("idx"), "pieces").alias("piece"), "embedding", "labels")
    side = told.join(pieces, "meeting_id").select(F.col("meeting_id").alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces").cast("long") - 1)).alias("p"), "k", "label", "n", "s")

    def judge(x: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x):
            v, ls = np.stack(x.embedding.to_numpy()).astype(float), np.stack(x.labels.to_numpy())
            for k in range(ls.shape[1]):
                of = told[told.k == k].sort_values("label")
                n, own = of.n.to_numpy(), ls[:, k]
                total = n - v @ np.stack(of.s.to_numpy()).T
                at = np.arange(len(v))
                a = total[at, own] / np.maximum(n[own] - 1, 1)
                other = total / n
                other[at, own] = np.inf
                b = other.min(1)
                out.append((x.meeting_id.iloc[0], k, float(np.where(n[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0).sum()), len(v)))
        return pd.DataFrame(out, columns=["meeting_id", "k", "s", "n"])

    scored = dealt.groupBy("meeting_id", "piece").cogroup(side.groupBy("m", "p")).applyInPandas(judge, "meeting_id long, k int, s double, n long")
    scores = scored.groupBy("meeting_id", "k").agg((F.sum("s") / F.sum("n")).alias("score"), F.sum("n").alias("rows"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        good = []
        for k, x in rows.groupby("k"):
            c = np.stack(x.s.to_numpy())
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
            apart = (1 - c @ c.T)[np.triu_indices(len(c), 1)].min()
            if x.score.iloc[0] >= LEAST_SILHOUETTE and x.n.min() >= LEAST_MEMBERS and x.n.min() / x.rows.iloc[0] >= LEAST_SHARE and apart >= LEAST_DISTANCE:
                good.append((int(k), x.score.iloc[0]))
        if not good:
            return pd.DataFrame({"meeting_id": rows.meeting_id.iloc[:1], "k": [-1]})
        near = NEAR_BEST_MANY if any(k >= 2 for k, _ in good) else NEAR_BEST
        best = max(s for _, s in good)
        return pd.DataFrame({"meeting_id": rows.meeting_id.iloc[:1], "k": [max(k for k, s in good if s >= best - near)]})

    return told.join(scores, ["meeting_id", "k"]).groupBy("meeting_id").applyInPandas(choose, "meeting_id long, k int")


def clustered(vectors: DataFrame, speakers: int | None = None, most: int = 8, local: int = LOCAL, block: int = BLOCK) -> DataFrame:
    """meeting_id, idx, embedding with label, for meetings of more than two rows. vectors: meeting_id, idx, embedding (of length 1)."""
    vectors = kept(vectors.select("meeting_id", "idx", "embedding"))
    made = merges(vectors, local, block)
    if speakers is not None:
        got = labels(vectors, made, max(2, speakers))
        return got.select("meeting_id", "idx", "embedding", (F.element_at("labels", -1) if speakers > 1 else F.lit(0)).alias("label"))
    got = kept(labels(vectors, made, most).where(F.size("labels") > 0))
    # a meeting may not be cut into as many clusters as it has rows
    got = got.join(got.groupBy("meeting_id").agg(F.count("*").alias("__n")), "meeting_id")
    got = got.withColumn("labels", F.slice("labels", 1, F.greatest(F.least(F.size("labels"), F.col("__n") - 2), F.lit(0)).cast("int"))).where(F.size("labels") > 0).drop("__n")
    return got.join(chosen(got), "meeting_id").select("meeting_id", "idx", "embedding", F.when(F.col("k") < 0, 0).otherwise(F.get("labels", F.col("k"))).alias("label"))
