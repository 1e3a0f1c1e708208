"""Speaker vectors: norms, similarities, centroids, matching, enrolment, clustering of a meeting's windows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from parley.operators.numbering import kept


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Between -1 and 1; 0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))).otherwise(0.0)


def unit(a: Column) -> Column:
    """a of length 1, or as it is without a length; the length is taken once, not for each number."""
    scaled = F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))
    return F.get(scaled, F.lit(0))


def matrix(vectors: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix; null arrays and elements are zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if not len(vectors):
        return np.zeros((0, 0))
    sizes = np.diff(vectors.offsets.to_numpy()) if not vectors.null_count else np.array([len(x) if x.is_valid else 0 for x in vectors])
    width = int(sizes.max())
    if set(sizes.tolist()) - {0, width}:
        raise ValueError("vectors of different lengths")
    out = np.zeros((len(vectors), width))
    out[sizes > 0] = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width) if width else 0
    return np.nan_to_num(out, copy=False)


def centroids(vectors: DataFrame, key: list[str], column: str = "embedding") -> DataFrame:
    """Per key: n, and the mean vector scaled to length 1. Each batch of rows gives one row of sums for each of its keys, so what is
    shuffled is vectors of sums, a few for each key and task."""
    kinds = ", ".join(f"`{k}` {vectors.schema[k].dataType.simpleString()}" for k in key)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = matrix(batch.column(batch.num_columns - 1))
            t = pa.table({k: batch.column(i) for i, k in enumerate(key)}).append_column("__row", pa.array(np.arange(batch.num_rows)))
            groups = t.group_by(key).aggregate([("__row", "list"), ("__row", "count")])
            sums = [m[np.asarray(x)].sum(0) for x in groups.column("__row_list").to_pylist()]
            cols = [groups.column(k).combine_chunks() for k in key]
            yield pa.RecordBatch.from_arrays([*cols, groups.column("__row_count").combine_chunks(), pa.array([x.tolist() for x in sums], pa.list_(pa.float64()))], names=[*key, "n", "v"])

    part = vectors.select(*key, column).mapInArrow(add, f"{kinds}, n long, v array<double>")
    both = part.groupBy(*key).agg(F.sum("n").alias("n"), F.collect_list("v").alias("vs"))  # a vector for each batch that holds the key
    whole = F.aggregate("vs", F.transform(F.get("vs", F.lit(0)), lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return both.select(*key, "n", unit(whole).alias("centroid"))


#: Numbers (references times their length) in one block of references: 64 MB.
BLOCK_NUMBERS = 8_000_000
#: Vectors that meet a block in one group, where the references take several.
GROUP_ROWS = 20_000


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def best_of(v: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of v the first row of refs (both of length 1) with the highest product, and that product. Products that differ by rounding alone are
    equal. Taken in strips, so that no more than a million products are held."""
    at, s = np.zeros(len(v), np.int64), np.zeros(len(v))
    strip = max(1, 1_000_000 // max(1, len(refs)))
    for lo in range(0, len(v), strip):
        d = np.clip(v[lo : lo + strip] @ refs.T, -1, 1)
        at[lo : lo + strip] = (d >= d.max(1, keepdims=True) - 1e-12).argmax(1)
        s[lo : lo + strip] = d[np.arange(len(d)), at[lo : lo + strip]]
    return at, s


def match(vectors: DataFrame, references: DataFrame, threshold: float | None = None, column: str = "embedding", among: str = "ref", block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """vectors with the nearest reference by cosine: among, similarity. references: among, centroid, as many as there are.

    The smaller among wins ties; a vector without length, or null, has similarity 0 to all. With a threshold, a best similarity under it gives null;
    without references both are null. Vectors are multiplied with a block of references at a time: references that fit one block are sent to
    all tasks; more are dealt into blocks, each vector meets each block in a group of its own, and the best of its blocks is taken.
    """
    kind = references.schema[among].dataType.simpleString()
    known = references.where(F.col(among).isNotNull() & F.col("centroid").isNotNull()).select(F.col(among).alias("ref"), "centroid")
    size = known.agg(F.count("*").alias("n"), F.max(F.size("centroid")).alias("width")).first()
    if not size["n"]:
        return vectors.withColumns({among: F.lit(None).cast(kind), "similarity": F.lit(None).cast("double")})
    blocks = -(-size["n"] * size["width"] // block_numbers)
    at, schema = vectors.columns.index(column), vectors.schema
    plain = [c for c in vectors.columns if c not in (among, "similarity")]
    if blocks == 1:
        got = known.toArrow().sort_by("ref")  # one block at most
        sent = vectors.sparkSession.sparkContext.broadcast((got.column("ref").combine_chunks(), unit_rows(matrix(got.column("centroid")))))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, refs = sent.value
            for batch in batches:
                if batch.num_rows:
                    which, s = best_of(unit_rows(_widened(matrix(batch.column(at)), refs.shape[1])), refs)
                    yield pa.RecordBatch.from_arrays([*batch.columns, names.take(pa.array(which)), pa.array(s)], names=[*batch.schema.names, "__ref", "__s"])

        out = vectors.mapInArrow(nearest, StructType([*schema.fields, StructField("__ref", references.schema[among].dataType), StructField("__s", DoubleType())]))
    else:
        groups = max(1, -(-vectors.count() // GROUP_ROWS))
        left = vectors.select(F.struct(*vectors.columns).alias("row"), F.monotonically_increasing_id().alias("id"), F.col(column).alias("v"))
        # the rows wait by their number, given once; their vectors alone go to every block
        left = kept(left).withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
        moved = left.select("id", "v", "group", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        dealt = known.select("ref", "centroid", F.pmod(F.xxhash64("ref", "centroid"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({"id": pa.array([], pa.int64()), "ref": pa.array([], b.schema.field("ref").type), "s": pa.array([], pa.float64())})
            b = b.sort_by("ref")
            refs = unit_rows(matrix(b.column("centroid")))
            which, s = best_of(unit_rows(_widened(matrix(a.column("v")), refs.shape[1])), refs)
            return pa.table({"id": a.column("id"), "ref": b.column("ref").take(pa.array(which)), "s": pa.array(s)})

        met = moved.groupBy("block", "group").cogroup(dealt.groupBy("block", "group")).applyInArrow(meet, f"id long, ref {kind}, s double")
        # of equal products the smaller ref: products of several blocks differ by rounding
        top = met.groupBy("id").agg(F.max("s").alias("top"), F.collect_list(F.struct("ref", "s")).alias("all"))  # one entry for each block
        best = top.select("id", "top", F.array_min(F.transform(F.filter("all", lambda x: x["s"] >= F.col("top") - 1e-12), lambda x: x["ref"])).alias("__ref"))
        out = left.select("id", "row").join(best, "id").select("row.*", "__ref", F.col("top").alias("__s"))
    ok = F.col("__s") >= threshold if threshold is not None else F.lit(True)
    return out.select(*plain, F.when(ok, F.col("__ref")).alias(among), F.col("__s").alias("similarity"))


def _widened(m: np.ndarray, width: int) -> np.ndarray:
    if m.shape[1] not in (0, width):
        raise ValueError("vectors and references of different lengths")
    return m if m.shape[1] else np.zeros((len(m), width))


def min_centroid_distance(cents: DataFrame, meeting: str, cluster: str) -> DataFrame:
    """Per meeting the least cosine distance between two of its clusters (few for each meeting)."""
    a = cents.select(meeting, F.col(cluster).alias("a"), F.col("centroid").alias("x"))
    b = cents.select(meeting, F.col(cluster).alias("b"), F.col("centroid").alias("y"))
    return a.join(b, meeting).where("a < b").groupBy(meeting).agg(F.min(1 - cosine(F.col("x"), F.col("y"))).alias("distance"))


def majority_label(windows: DataFrame) -> DataFrame:
    """Per meeting and segment the label with the longest windows, the smaller of equals. windows: meeting_id, seq, label, from_ms, to_ms."""
    by = windows.groupBy("meeting_id", "seq", "label").agg(F.sum(F.col("to_ms") - F.col("from_ms")).alias("ms"))
    return by.groupBy("meeting_id", "seq").agg(F.max_by("label", F.struct("ms", -F.col("label"))).alias("label"))


def cluster_durations(windows: DataFrame) -> DataFrame:
    return windows.groupBy("meeting_id", "label").agg(F.sum(F.col("to_ms") - F.col("from_ms")).alias("total_ms"), F.count("*").alias("n"))


def enrol(registry: DataFrame, new: DataFrame) -> DataFrame:
    """registry (name, embedding, samples) with new vectors (name, embedding) put in: a known name gets the mean weighted by its samples, of length 1."""
    n = new.select("name", F.col("embedding").alias("e"))
    both = registry.join(n, "name", "full_outer")
    k = F.coalesce("samples", F.lit(0))
    mean = F.zip_with(F.coalesce("embedding", F.transform("e", lambda x: x * 0)), "e", lambda a, b: (a.cast("double") * k + b.cast("double")) / (k + 1))
    return both.select("name", F.when(F.col("e").isNull(), F.col("embedding").cast("array<double>")).otherwise(unit(mean)).alias("embedding"), F.when(F.col("e").isNull(), k).otherwise(k + 1).cast("long").alias("samples"))


# Fixed values of the estimate of the number of speakers.
LEAST_SILHOUETTE, LEAST_MEMBERS, LEAST_SHARE, LEAST_DISTANCE = 0.24, 2, 0.04, 0.18
NEAR_BEST, NEAR_BEST_MANY = 0.07, 0.11


def average_linkage(d: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by average linkage over a distance matrix."""
    n = len(d)
    d, size, alive, label = d.astype(float).copy(), np.ones(n), np.ones(n, bool), np.arange(n)
    np.fill_diagonal(d, np.inf)
    for _ in range(n - k):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def chained_linkage(u: np.ndarray, sizes: np.ndarray | None = None) -> list[tuple[float, int, int]]:
    """All merges (distance, i, j) of average linkage over vectors of length 1, or over clusters of sizes with the sums u of such, lowest first, by chains of nearest
    neighbours. The mean distance of two clusters is 1 less the product of their sums over their sizes, so memory grows with the vectors and no matrix is held."""
    n = len(u)
    total, size, dead = u.astype(float).copy(), np.ones(n) if sizes is None else sizes.astype(float), np.zeros(n, bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.argmin(dead))]
        a = chain[-1]
        d = 1 - (total @ total[a]) / (size * size[a])
        d[dead] = np.inf
        d[a] = np.inf
        b = int(np.argmin(d))
        if len(chain) > 1 and d[chain[-2]] <= d[b] + 1e-12:  # so far a chain's distances fall, which rounding must not undo
            i, j = sorted(chain[-2:])
            merges.append((float(d[chain[-2]]), i, j))
            total[i] += total[j]
            size[i] += size[j]
            dead[j] = True
            del chain[-2:]
        else:
            chain.append(b)
    return sorted(merges, key=lambda m: m[0])


#: Near clusters in a list, and lists that are made at once.
LISTED, LISTS = 24, 64


def listed_linkage(u: np.ndarray, sizes: np.ndarray | None = None) -> list[tuple[float, int, int]]:
    """As chained_linkage, of many rows, lowest merge first.

    Each cluster has a list of the clusters that were nearest to it, and a bound that all others are no nearer than. Under average linkage a merged cluster is no nearer to a third one than the
    nearer of its two parts was, so a bound holds on, and that of a merged cluster is the mean of its parts' bounds by size. So distances to all clusters are taken only for those whose list has none
    within the bound any more, of which there are about as many as rows: after the first lists, time is hardly more than linear. Memory grows with the vectors and lists.
    """
    n = len(u)
    total, size = u.astype(float).copy(), np.ones(n) if sizes is None else sizes.astype(float)
    mean = total / size[:, None]
    top, made, told = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)  # the cluster that took a row in; the merge that made a cluster; the merges that its list knows of
    none = np.zeros(0, np.int64), np.zeros(0)
    lists = [none] * n
    bound, key = np.zeros(n), np.zeros(n)
    alive, near = np.arange(n), mean.copy()  # clusters, and some that are no more; their means
    merges: list[tuple[float, int, int]] = []

    def put(r: int, x: np.ndarray, y: np.ndarray, most: int) -> None:
        """x at distances y is r's list, without what is beyond its bound or most entries."""
        order = np.argsort(y, kind="stable")
        order = order[: np.searchsorted(y[order], bound[r], "right")]
        if len(order) > most:
            bound[r] = y[order[most]]
            order = order[:most]
        lists[r], told[r] = (x[order], y[order]), len(merges)

    def fill(rows: np.ndarray) -> None:
        d = 1 - mean[rows] @ near.T
        d[:, top[alive] != alive] = np.inf
        d[np.arange(len(rows)), np.searchsorted(alive, rows)] = np.inf
        if LISTED + 1 < len(alive):
            some = np.argpartition(d, LISTED, axis=1)[:, : LISTED + 1]
            for r, x, y in zip(rows.tolist(), some, np.take_along_axis(d, some, 1), strict=True):
                bound[r] = y.max()  # of the last one in a list and all that are in none
                put(r, alive[x[y < np.inf]], y[y < np.inf], LISTED)
        else:
            for r, y in zip(rows.tolist(), d, strict=True):
                bound[r] = np.inf
                put(r, alive[y < np.inf], y[y < np.inf], n)

    def renewed(r: int) -> tuple[np.ndarray, np.ndarray]:
        """r's list with what has been merged since."""
        x = now = lists[r][0]
        while (top[now] != now).any():
            now = top[now]
        if (now != x).any() or (made[now] > told[r]).any():
            now = np.unique(now)
            put(r, now, 1 - mean[now] @ mean[r], n)
        told[r] = len(merges)
        return lists[r]

    def sure(r: int) -> bool:
        x, y = renewed(r)
        return len(y) > 0 and y[0] <= bound[r]

    def push(r: int) -> None:
        """In order of what its nearest cluster is at least away."""
        key[r] = min([bound[r], *lists[r][1][:1].tolist()])
        heapq.heappush(heap, (key[r], r))

    def pop() -> tuple[float, int] | None:
        while heap:
            d, r = heapq.heappop(heap)
            if top[r] == r and key[r] == d:
                return d, r
        return None

    heap: list[tuple[float, int]] = []
    for lo in range(0, n, LISTS):
        fill(np.arange(lo, min(n, lo + LISTS)))
    for r in range(n):
        push(r)
    while len(merges) < n - 1:
        d, r = pop()
        if not sure(r):
            if bound[r] > d:
                push(r)
                continue
            # others that will soon need a list
            rows, back = [r], []
            while len(rows) < LISTS and len(back) < 4 * LISTS and (found := pop()):
                (back if sure(found[1]) else rows).append(found[1])
            if 4 * (n - len(merges)) < 3 * len(alive):
                alive = np.flatnonzero(top == np.arange(n))
                near = mean[alive]
            fill(np.sort(rows))
            for x in (*rows, *back):
                push(x)
            continue
        x, y = lists[r]
        if y[0] > d:
            push(r)
            continue
        i, j = sorted((r, int(x[0])))
        merges.append((float(y[0]), i, j))
        both = np.union1d(renewed(i)[0], renewed(j)[0])
        bound[i] = (size[i] * bound[i] + size[j] * bound[j]) / (size[i] + size[j])
        total[i] += total[j]
        size[i] += size[j]
        mean[i] = near[np.searchsorted(alive, i)] = total[i] / size[i]
        top[j], made[i], lists[j] = i, len(merges), none
        both = both[(both != i) & (both != j)]
        put(i, both, 1 - mean[both] @ mean[i], 2 * LISTED)
        push(i)
    return sorted(merges, key=lambda m: m[0])


def cut(merges: list[tuple[float, int, int]], n: int, k: int) -> np.ndarray:
    """Labels of k clusters after the lowest merges."""
    up = np.arange(n)

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for _, i, j in merges[: n - k]:
        i, j = sorted((top(i), top(j)))
        up[j] = i
    return np.unique([top(x) for x in range(n)], return_inverse=True)[1]


def linked(u: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters of vectors of length 1 by average linkage of cosine distance."""
    return cut(chained_linkage(u), len(u), k)


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    return _silhouette(d @ np.eye(labels.max() + 1)[labels], labels)


def _silhouette(total: np.ndarray, labels: np.ndarray) -> float:
    """total: of each row the sum of its distances to each label's rows."""
    count = np.bincount(labels)
    own = count[labels]
    a = total[np.arange(len(labels)), labels] / np.maximum(own - 1, 1)
    other = total / count
    other[np.arange(len(labels)), labels] = np.inf
    b = other.min(1)
    s = np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0)
    return float(s.mean())


def estimate_speakers(vectors: np.ndarray, most: int = 8) -> np.ndarray:
    """Labels for an unknown number of speakers: of the numbers whose clustering is clean, the largest that scores near the best; else one. The
    merges are made once and cut at each number."""
    n = len(vectors)
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    merges = chained_linkage(v)
    good: list[tuple[int, float, np.ndarray]] = []
    for k in range(2, min(most, n - 1) + 1):
        labels = cut(merges, n, k)
        counts = np.bincount(labels)
        score = _silhouette(counts - v @ np.stack([v[labels == i].sum(0) for i in range(k)]).T, labels)
        c = np.stack([v[labels == i].mean(0) for i in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        apart = (1 - c @ c.T)[np.triu_indices(k, 1)].min()
        if score >= LEAST_SILHOUETTE and counts.min() >= LEAST_MEMBERS and counts.min() / n >= LEAST_SHARE and apart >= LEAST_DISTANCE:
            good.append((k, score, labels))
    if not good:
        return np.zeros(n, int)
    best = max(s for _, s, _ in good)
    near = NEAR_BEST_MANY if any(k >= 4 for k, _, _ in good) else NEAR_BEST
    return max((g for g in good if g[1] >= best - near), key=lambda g: g[0])[2]


#: Windows of a meeting that one task clusters; a larger meeting is dealt to many.
ONE_TASK = 2_000


def by_size(vectors: DataFrame, one_task: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of meetings of up to one_task rows, and of larger ones (None if there are none)."""
    large = vectors.groupBy("meeting_id").agg(F.count("*").alias("n")).where(F.col("n") > one_task).select("meeting_id")
    if large.isEmpty():
        return vectors, None
    return vectors.join(large, "meeting_id", "left_anti"), vectors.join(large, "meeting_id", "left_semi")


def cluster_meetings(vectors: DataFrame, speakers: int | None = None, column: str = "embedding", one_task: int = ONE_TASK) -> DataFrame:
    """meeting_id, idx, label: the windows of each meeting clustered by average linkage of cosine distance, into speakers clusters or an estimated number.

    A meeting of up to one_task windows is one task's, in time quadratic in its windows and memory linear in them; larger ones are merged in rounds by many
    tasks. Labels are numbered in the order in which they occur.
    """
    from parley.operators import linkage

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        v = np.stack(rows[column].to_numpy()).astype(float)
        if speakers is not None:
            labels = linked(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), min(speakers, len(v)))
        else:
            labels = estimate_speakers(v) if len(v) > 2 else np.zeros(len(v), int)
        return pd.DataFrame({"meeting_id": rows.meeting_id, "idx": rows.idx, "label": labels})

    small, large = by_size(vectors.select("meeting_id", "idx", column), one_task)
    got = small.groupBy("meeting_id").applyInPandas(one, "meeting_id long, idx long, label int")
    if large is not None:
        got = got.unionByName(linkage.clustered(large.select("meeting_id", "idx", unit(F.col(column)).alias("embedding")), speakers, local=one_task).select("meeting_id", "idx", "label"))
    # as they occur: a few labels for each meeting
    first = got.groupBy("meeting_id", "label").agg(F.min("idx").alias("first"))
    order = first.select("meeting_id", F.col("label").alias("old"), (F.row_number().over(W.partitionBy("meeting_id").orderBy("first")) - 1).cast("int").alias("label"))
    return got.withColumnRenamed("label", "old").join(order, ["meeting_id", "old"]).select("meeting_id", "idx", "label")


def nearest_label(windows: DataFrame) -> DataFrame:
    """For each window the label of the nearest window (by index; the earlier of equals) of its meeting that has another label."""
    w = W.partitionBy("meeting_id").orderBy("idx")
    # the nearest other label on either side stands at the edge of the run of equal labels
    start = F.when(F.col("label").eqNullSafe(F.lag("label").over(w)), None).otherwise(F.struct("idx", F.lag("idx").over(w).alias("pi"), F.lag("label").over(w).alias("pl")))
    rows = windows.withColumn("run", start)
    rows = rows.withColumn("before", F.last("run", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    back = W.partitionBy("meeting_id").orderBy(F.desc("idx"))
    end = F.when(F.col("label").eqNullSafe(F.lag("label").over(back)), None).otherwise(F.struct("idx", F.lag("idx").over(back).alias("ni"), F.lag("label").over(back).alias("nl")))
    rows = rows.withColumn("runb", end).withColumn("after", F.last("runb", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, W.currentRow)))
    left, right = F.col("idx") - F.col("before.pi"), F.col("after.ni") - F.col("idx")
    near = F.when(right.isNull() | (left <= right), F.col("before.pl")).otherwise(F.col("after.nl"))
    return rows.select("meeting_id", "idx", "label", F.coalesce(near, F.col("after.nl")).alias("other"))
