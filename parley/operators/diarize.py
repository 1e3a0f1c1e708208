"""From windows of speech with vectors to speakers: clustering, cautious merging, labels of segments, names from a registry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import linkage, vectors
from parley.operators.numbering import kept
from parley.operators.sequence import forward_fill

# By the number of clusters (4 and more, 3, fewer) the distance under which two are one speaker, and the length up to which
# a cluster is too short to be a speaker's; the share of windows up to which it may be; the distance up to which it is moved.
SIMILAR = {4: 0.08, 3: 0.12, 2: 0.18}
SHORT_MS = {4: 0, 3: 2000, 2: 5000}
SHORT_SHARE, MOVE_DISTANCE = 0.08, 0.18


def _dense(labels: np.ndarray) -> np.ndarray:
    return np.unique(labels, return_inverse=True)[1]


def _distances(v: np.ndarray, labels: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """Cosine distances between the mean vectors of labels 0 .. k-1, infinite on the diagonal. With of, v has the sums of groups of windows, of each window's group,
    and a group's windows share their label."""
    if of is not None:
        own = np.zeros(len(v), int)
        own[of] = labels
        labels = own
    member = np.eye(labels.max() + 1)[labels]
    c = (member.T @ v) / member.sum(0)[:, None]
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    d = 1 - c @ c.T
    np.fill_diagonal(d, np.inf)
    return d


def merge_similar(v: np.ndarray, labels: np.ndarray, limit: float, of: np.ndarray | None = None) -> np.ndarray:
    """The two nearest clusters become one, the smaller takes the larger's label, as long as they are nearer than limit."""
    labels = _dense(labels)
    while labels.max() > 0:
        d = _distances(v, labels, of)
        i, j = np.unravel_index(int(np.argmin(d)), d.shape)
        if d[i, j] >= limit:
            break
        i, j = min(i, j), max(i, j)
        size = np.bincount(labels)
        labels = _dense(np.where(labels == (i if size[i] <= size[j] else j), j if size[i] <= size[j] else i, labels))
    return labels


def beside(labels: np.ndarray, of: int) -> int | None:
    """The other label whose window is nearest in order to one of label of; of equally near ones the earlier."""
    own, other = np.flatnonzero(labels == of), np.flatnonzero(labels != of)
    if not len(other) or not len(own):
        return None
    after = np.searchsorted(own, other)
    gap = np.minimum(np.abs(other - own[np.maximum(after - 1, 0)]), np.abs(other - own[np.minimum(after, len(own) - 1)]))
    return int(labels[other[int(np.argmin(gap))]])


def merge_short(v: np.ndarray, labels: np.ndarray, ms: np.ndarray, limit_ms: int, of: np.ndarray | None = None) -> np.ndarray:
    """Short clusters (one window, or few) go, the shortest first, to the label beside them; a label beside of 0 counts as none, and then the nearest
    in distance is taken. A cluster of several windows that is far from all others ends it."""
    labels = _dense(labels)
    while labels.max() > 0:
        size, total = np.bincount(labels), np.bincount(labels, weights=ms)
        short = [(total[k], size[k], k) for k in range(len(size)) if total[k] <= limit_ms and (size[k] == 1 or size[k] / len(labels) <= SHORT_SHARE)]
        if not short:
            break
        k = min(short)[2]
        d = _distances(v, labels, of)[k]
        near, distance = (int(np.argmin(d)), float(d.min())) if d.min() < 1 else (None, 1.0)
        to = beside(labels, k) or near
        if to is None or (distance > MOVE_DISTANCE and size[k] > 1):
            break
        labels = _dense(np.where(labels == k, to, labels))
    return labels


def merge_cautiously(v: np.ndarray, labels: np.ndarray, ms: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    k = min(4, max(2, len(set(labels.tolist()))))
    labels = merge_similar(v, labels, SIMILAR[k], of)
    return merge_short(v, labels, ms, SHORT_MS[k], of) if SHORT_MS[k] else labels


def cluster_windows(windows: DataFrame, speakers: int | None = None, one_task: int = vectors.ONE_TASK) -> DataFrame:
    """windows (meeting_id, seq, idx, from_ms, to_ms, embedding) with label. Without a number of speakers, that is estimated and clusters are merged cautiously.

    A meeting of up to one_task windows is one task's; larger ones are merged in rounds by many tasks, and what then comes together for one of them is its
    windows' labels and lengths, and a vector for each label.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        v = np.stack(rows.embedding.to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        if speakers is not None:
            labels = vectors.linked(v, max(1, min(speakers, len(v))))
        else:
            labels = vectors.estimate_speakers(v) if len(v) > 2 else np.zeros(len(v), int)
            labels = merge_cautiously(v, labels, (rows.to_ms - rows.from_ms).to_numpy().astype(float))
        return pd.DataFrame({"meeting_id": rows.meeting_id, "idx": rows.idx, "label": labels})

    small, large = vectors.by_size(windows.select("meeting_id", "idx", "from_ms", "to_ms", "embedding"), one_task)
    found = small.groupBy("meeting_id").applyInPandas(one, "meeting_id long, idx long, label int")
    if large is not None:
        got = linkage.clustered(large.select("meeting_id", "idx", vectors.unit(F.col("embedding")).alias("embedding")), speakers, local=one_task)
        found = found.unionByName((got if speakers is not None else _merged(kept(got), large)).select("meeting_id", "idx", "label"))
    return windows.drop("label").join(found, ["meeting_id", "idx"])


def _merged(got: DataFrame, windows: DataFrame) -> DataFrame:
    """Clusters of large meetings, merged cautiously."""
    told = linkage.sums(got.select("meeting_id", "embedding", F.array("label").alias("labels"))).select("meeting_id", "label", "s")

    def one(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"meeting_id": [], "idx": [], "label": []})
        rows, told = rows.sort_values("idx"), told.sort_values("label")
        of = rows.label.to_numpy()
        return pd.DataFrame({"meeting_id": rows.meeting_id, "idx": rows.idx, "label": merge_cautiously(np.stack(told.s.to_numpy()), of, rows.ms.to_numpy().astype(float), np.searchsorted(told.label.to_numpy(), of))})

    lengths = windows.select("meeting_id", "idx", (F.col("to_ms") - F.col("from_ms")).alias("ms"))
    narrow = got.select("meeting_id", "idx", "label").join(lengths, ["meeting_id", "idx"])
    return narrow.groupBy("meeting_id").cogroup(told.select(F.col("meeting_id").alias("m"), "label", "s").groupBy("m")).applyInPandas(one, "meeting_id long, idx long, label int")


def diarize(segments: DataFrame, windows: DataFrame, speakers: int | None = None, registry: DataFrame | None = None, threshold: float = 0.65) -> DataFrame:
    """segments with speaker: the label with most of a segment's window time, as its registered name (registry: ref, centroid) if one is near
    enough, else SPEAKER_nn; a segment without windows takes the last speaker known in the meeting."""
    labelled = cluster_windows(windows, speakers)
    major = vectors.majority_label(labelled).withColumn("speaker", F.format_string("SPEAKER_%02d", "label"))
    if registry is not None:
        cents = vectors.centroids(labelled, ["meeting_id", "label"])
        names = vectors.match(cents, registry, threshold, "centroid").select("meeting_id", "label", F.col("ref").alias("name"))
        major = major.join(names, ["meeting_id", "label"], "left").withColumn("speaker", F.coalesce("name", "speaker"))
    out = segments.drop("speaker").join(major.select("meeting_id", "seq", "speaker"), ["meeting_id", "seq"], "left")
    return forward_fill(out, "speaker", "speaker")
