"""Exact Jaccard self-join on word shingles with a token-group matrix.

Documents with the same shingles are one node. Nodes are partitioned into groups of similar ones: in each of ROUNDS rounds, nodes that have
the same least shingles under two hashes are compared, in blocks of about BLOCK, and all that links connect, over the rounds, become one
group. A group is thus a connected set, and a family of n near copies costs about n * BLOCK comparisons.

Each group stores the union of its members' prefix tokens, those that come first in a global order and of which two linked documents must share some: the token-group
matrix has one row for such a token and a group, however many members hold it. Whole unions are made for the groups that are opened, not stored. Two groups can only hold a further link if they share enough of the tokens that come first in a global order, so
group pairs are found by joining the matrix with itself on tokens, bounded by what they share, and only pairs that pass are
opened: first their tops are compared, then, where that does not connect them, the members of one against those of the other that
the other's whole token union lets qualify.

The global order is by the count of a token's slot in a sketch of fixed width over all documents, rare ones first, then by hash. Any order
gives right results; this one keeps what common passages consist of out of the matrix.

Links are needed for what they connect: no pair is compared within a group, or between groups that are connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm._store import BROADCAST_ROWS, drop_table, materialise, sent
from parley.llm._text import IS_SPACE, LOWER, PLACE, mix, prefix_hash, runs, sequence_hash, slices, span_hash
from parley.llm.graph import components

SHINGLE = 5
#: Jaccard similarity of a link, as a fraction.
NUM, DEN = 4, 5
BLOCK = 96
#: Rounds of grouping, and least tokens, each under a hash of its own, that are equal in one. One alone would gather what shares a passage.
ROUNDS, LEASTS = 3, 2
#: Guests that visit a block of a group in one task.
ROOM = 400
#: log2 of the sketch's width, and the pieces it is summed in.
SKETCH_BITS, PIECES = 20, 64
LEAST = [f"least{r}" for r in range(ROUNDS)]
NULL_ID = -(1 << 63)
U64 = np.uint64


def sets_of(texts: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; of a text of fewer than k words the hash of all of them; else none."""
    for lo, hi, data, offs in slices(texts):
        data = LOWER[data]
        start, end, first = runs(~IS_SPACE[data], offs)
        words = span_hash(prefix_hash(data), start, end)
        grams = sequence_hash(words, k)
        first = first.tolist()
        for i in range(hi - lo):
            s, e = first[i], first[i + 1]
            yield np.unique(grams[s : e - k + 1]) if e - s >= k else sequence_hash(words[s:e], e - s) if e > s else np.zeros(0, U64)


def prefix_len(n: int) -> int:
    """How many first tokens of a set of n must meet those of any linked set."""
    return n - -(-NUM * n // DEN) + 1


def _sketch(docs: DataFrame) -> DataFrame:
    """piece, counts (uint32 of each slot of the piece): how many tokens of all documents fall into each slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            got, held, seen = [], 0, set()
            for s in sets_of(batch.column(0)):
                if len(s) and (key := (len(s), int(s[0]), int(s[-1]), int(s.sum()))) not in seen:
                    seen.add(key)
                    got.append(s)
                    held += len(s)
                if held > 1 << 20:
                    total += np.bincount(np.concatenate(got) >> U64(64 - SKETCH_BITS), minlength=len(total))
                    got, held = [], 0
            if got:
                total += np.bincount(np.concatenate(got) >> U64(64 - SKETCH_BITS), minlength=len(total))
        if total.any():
            parts = total.astype("<u4").reshape(PIECES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["piece", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = 0
        for c in table.column("counts"):
            total = total + np.frombuffer(c.as_buffer(), "<u4").astype(np.int64)
        return pa.table({"piece": table.column("piece").slice(0, 1), "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())})

    schema = "piece int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema).withColumn("salt", F.spark_partition_id() % 64)
    return parts.groupBy("piece", "salt").applyInArrow(lambda t: add(t.drop(["salt"])), schema).groupBy("piece").applyInArrow(add, schema)


def slot_counts(docs: DataFrame) -> np.ndarray:
    """How many tokens fall into each slot of the sketch, in at most 20 bits. As many slots whatever the input."""
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in _sketch(docs).collect():  # PIECES rows, 4 MB in all
        n = len(total) // PIECES
        total[r["piece"] * n : (r["piece"] + 1) * n] = np.frombuffer(bytes(r["counts"]), "<u4")
    shift = max(0, int(np.median(total)).bit_length() - 16)
    return np.minimum(total >> shift, (1 << 20) - 1).astype(np.uint32)


def _signatures(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc_id, n, s1, s2 (the set's hash), least0 ... (of each round, a hash of its least tokens), tokens (the first ones; null where the batch
    already holds the set)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # 4 MB

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value.astype(U64) << U64(44)
        for batch in batches:
            n, keys, least, tokens, seen = [], [], [], [], set()
            for s in sets_of(batch.column(1)):
                n.append(len(s))
                if not len(s):
                    keys.append((0, 0)), least.append((0,) * ROUNDS), tokens.append(None)
                    continue
                keys.append(set_key(s))
                mins = np.array([mix(s ^ PLACE[3 + i]).min() for i in range(ROUNDS * LEASTS)]).reshape(ROUNDS, LEASTS)
                least.append(tuple(int(sequence_hash(m, LEASTS)[0].view(np.int64)) for m in mins))
                if keys[-1] in seen:
                    tokens.append(None)
                    continue
                seen.add(keys[-1])
                order = np.argsort(often[s >> U64(64 - SKETCH_BITS)] | (s >> U64(20)), kind="stable")
                tokens.append(s[order[: prefix_len(len(s))]].view(np.int64))
            longs = [pa.array([x[i] for x in rows], pa.int64()) for rows, k in ((keys, 2), (least, ROUNDS)) for i in range(k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), *longs, pa.array(tokens, pa.list_(pa.int64()))], names=["doc_id", "n", "s1", "s2", *LEAST, "tokens"])

    return docs.mapInArrow(sign, "doc_id long, n int, s1 long, s2 long, " + ", ".join(f"{c} long" for c in LEAST) + ", tokens array<long>")


def _sent(ids: DataFrame) -> DataFrame:
    return sent(ids, BROADCAST_ROWS)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set."""
    return int(mix(s ^ PLACE[1]).sum().view(np.int64)), int(mix(s ^ PLACE[2]).sum().view(np.int64))


def _matrix(nodes: DataFrame, partitions: int) -> DataFrame:
    """nodes: cl, lone, low, high, tokens. Returns token, cl, lone, low, high, at (the token's place in a lone node): tokens of two groups or more.

    Each batch first unites the tokens of a group's members, so that few rows of a large group are shuffled; a token's rows then meet once.
    """

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offs = batch.column(4).flatten().to_numpy(), batch.column(4).offsets.to_numpy()
            offs = offs - offs[0]
            at = np.arange(len(flat)) - np.repeat(offs[:-1], np.diff(offs))
            row = np.repeat(np.arange(batch.num_rows), np.diff(offs))
            cl, lone = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            shared = np.flatnonzero(~lone[row])
            order = shared[np.lexsort((flat[shared], cl[row[shared]]))]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (flat[order][1:] != flat[order][:-1]) | (cl[row[order]][1:] != cl[row[order]][:-1])
            keep = np.concatenate([np.flatnonzero(lone[row]), order[fresh]])
            r = row[keep]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (flat[keep], cl[r], lone[r], batch.column(2).to_numpy()[r], batch.column(3).to_numpy()[r], at[keep].astype(np.int32))], names=["token", "cl", "lone", "low", "high", "at"])

    rows = nodes.select("cl", "lone", "low", "high", "tokens").mapInArrow(unite, "token long, cl long, lone boolean, low int, high int, at int")
    one = rows.repartition(partitions, "token").groupBy("token", "cl").agg(*(F.first(c).alias(c) for c in ("lone", "low", "high", "at")))
    return one.withColumn("groups", F.count("*").over(W.partitionBy("token"))).where("groups > 1").drop("groups")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of a shares with each of b: the product of the incidence matrices over the shared tokens."""
    flat = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, width = np.zeros((len(a), len(b)), np.float64), 2048
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s, e = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(a) + len(b), width), np.float32)
        m[row[s:e], column[s:e] - lo] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out.astype(np.int64)


def links(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Which sets of a are linked with which of b."""
    na, nb = np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])[None, :]
    common = overlaps(a, b)
    return DEN * common >= NUM * (na + nb - common)


def across(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """links(a, b), where only the sets that a group's whole token union lets qualify are compared."""

    def may(x: list[np.ndarray], y: list[np.ndarray]) -> list[int]:
        union = np.unique(np.concatenate(y))
        return [i for i, s in enumerate(x) if DEN * int(np.isin(s, union, assume_unique=True).sum()) >= NUM * len(s)]

    out = np.zeros((len(a), len(b)), bool)
    if not (a and b):
        return out
    i, j = may(a, b), may(b, a)
    if i and j:
        out[np.ix_(i, j)] = links([a[x] for x in i], [b[x] for x in j])
    return out


def parts_of(linked: np.ndarray) -> np.ndarray:
    """The least index that each one reaches."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], label[:, None]).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _as_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, U64)


def _within(table: pa.Table) -> pa.Table:
    """Of one block of nodes: each that reaches a smaller one by links, with the smallest that it reaches."""
    table = table.sort_by("node")
    nodes, sets = table.column("node").to_numpy(), [_as_set(x) for x in table.column("set").to_pylist()]
    part = parts_of(links(sets, sets) | np.eye(len(sets), dtype=bool))
    moved = np.flatnonzero(part != np.arange(len(part)))
    return pa.table({"node": nodes[moved], "top": nodes[part[moved]]})


def _opened(table: pa.Table) -> pa.Table:
    """Of a block of one group's members (side 0) and guests of other groups (side 1): groups that a link between member and guest joins."""
    sides = table.column("side").to_numpy()
    cl, sets = table.column("cl").to_numpy(), [_as_set(x) for x in table.column("set").to_pylist()]
    i, j = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    x, y = np.nonzero(across([sets[k] for k in i], [sets[k] for k in j]))
    pairs = np.unique(np.stack([cl[i[x]], cl[j[y]]], axis=1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _alike_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [bool(links([_as_set(x)], [_as_set(y)])[0, 0]) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])


def _sets(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set of nodes (doc_id, node, s2), read from their documents again. Rows of the id with another text are passed over."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                b = batch.slice(lo, 1000)
                sets = list(sets_of(b.column(2)))
                ok = pa.array([set_key(s) == k for s, k in zip(sets, zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), pa.array([s.tobytes() for s in sets], pa.binary()).filter(ok)], names=["node", "set"])

    return rows.join(_sent(nodes.select("doc_id", "node", "s2")), "doc_id").select("node", "s2", "text").mapInArrow(make, "node long, set binary")


def _groups(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node, top: the nodes of groups of several, but the tops, each with its group's top. nodes: node, least0 ..., those that have a set."""
    steps = []
    for r in range(ROUNDS):
        met = nodes.groupBy(LEAST[r]).agg(F.count("*").alias("k")).where("k > 1")
        # blocks of one key hold other nodes in each round, so that links join them
        block = F.pmod(F.xxhash64("node", F.lit(r)), F.ceil(F.col("k") / BLOCK))
        dealt = materialise(nodes.join(_sent(materialise(met, "shingle-keys")), LEAST[r]).select("node", F.xxhash64(LEAST[r], block).alias("gid")), "shingle-blocks")
        steps.append(materialise(sets.join(_sent(dealt), "node").groupBy("gid").applyInArrow(_within, "node long, top long"), "shingle-step"))
    links = steps[0]
    for step in steps[1:]:
        links = links.unionByName(step)
    return components(links.select(F.col("node").alias("a"), F.col("top").alias("b"))).where("node <> component").withColumnRenamed("component", "top")


def _tokens(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: keys (bigint), set. A row for each token of a set: keys, token."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                sets = [_as_set(x) for x in b.column(len(keys)).to_pylist()]
                n = [len(x) for x in sets]
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(b.column(i).to_numpy(), n)) for i in range(len(keys))), pa.array(flat)], names=[*keys, "token"])

    return rows.select(*keys, "set").mapInArrow(each, ", ".join(f"{k} long" for k in [*keys, "token"]))


def _visited(visits: DataFrame, every: DataFrame) -> DataFrame:
    """Pairs of groups that a link between their members joins. visits: host, cl (the guest group), members (of the host); every: node, set, cl.

    A guest goes on only if enough of its tokens are in the host group's token union; what is left is dealt in rooms of guests and blocks of hosts, both by node,
    so that no group stands in one task.
    """
    union = _tokens(every.join(_sent(materialise(visits.select(F.col("host").alias("cl")).distinct(), "shingle-hosts")), "cl").withColumnRenamed("cl", "host"), ["host"]).distinct()
    guests = materialise(visits.select("host", "cl").join(every, "cl").select("host", "cl", "node", "set"), "shingle-guests")
    held = _tokens(guests, ["host", "node"]).join(union, ["host", "token"]).groupBy("host", "node").agg(F.count("*").alias("held"))
    fit = materialise(guests.join(held, ["host", "node"]).where(DEN * F.col("held") >= NUM * (F.octet_length("set") / 8)).drop("held"), "shingle-fit")
    rooms = fit.groupBy("host").agg(F.ceil(F.count("*") / ROOM).alias("rooms")).join(visits.groupBy("host").agg(F.ceil(F.max("members") / BLOCK).alias("blocks")), "host")
    rooms = materialise(rooms, "shingle-rooms")
    counted = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    guest = fit.join(_sent(rooms), "host").withColumn("room", F.pmod(F.xxhash64("node"), F.col("rooms"))).withColumn("block", counted("blocks")).select("host", "room", "block", F.lit(1).alias("side"), "cl", "set")
    host = every.join(_sent(rooms.withColumn("cl", F.col("host"))), "cl").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("room", counted("rooms")).select("host", "room", "block", F.lit(0).alias("side"), "cl", "set")
    return host.unionByName(guest).groupBy("host", "room", "block").applyInArrow(_opened, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the smallest id reachable by links, its own included).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a set holds the distinct sequences of SHINGLE words, or, of a shorter text, all of
    its words as one. Texts without words, and nulls, are linked with nothing. Rows that share an id are one place in
    the graph: what any of them links to, all reach. A null id counts as the smallest and is returned as null. Shingles are compared
    by 64-bit hashes. Every link takes part in the components; links between members of one component are not listed.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    whole = materialise(_signatures(rows, slot_counts(rows)), "shingle-signatures")
    signed = materialise(whole.select("doc_id", "n", F.col("s1").alias("node"), "s2"), "shingle-documents")

    # one node for each different set, which its smallest document stands for
    first = [F.first(c).alias(c) for c in ("n", *LEAST)]
    full = whole.where("n > 0").withColumnRenamed("s1", "node").groupBy("node", "s2").agg(F.min("doc_id").alias("doc_id"), *first, F.first("tokens", ignorenulls=True).alias("tokens"))
    full = materialise(full, "shingle-nodes")
    drop_table(whole)
    nodes = materialise(full.drop("tokens"), "shingle-names")

    # groups
    keys = nodes.select("node", F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.col(c).alias("least")) for r, c in enumerate(LEAST)))).alias("k")).select("node", "k.*")
    often = materialise(keys.groupBy("r", "least").agg(F.count("*").alias("k")).where("k > 1").select("r", "least"), "shingle-often")
    near = materialise(keys.join(_sent(often), ["r", "least"], "left_semi").select("node").distinct(), "shingle-near")
    candidates = materialise(nodes.join(_sent(near), "node", "left_semi"), "shingle-candidates")
    sets = materialise(_sets(rows, candidates), "shingle-sets")
    moved = materialise(_groups(candidates.select("node", *LEAST), sets), "shingle-groups")
    members = moved.unionByName(moved.select(F.col("top").alias("node"), "top").distinct())
    sizes = members.join(nodes.select("node", "n"), "node").groupBy("top").agg(F.count("*").alias("members"), F.min("n").alias("low"), F.max("n").alias("high"))
    many = materialise(members.join(sizes, "top").withColumnRenamed("top", "cl"), "shingle-members")

    # the matrix's tokens that two groups or more hold, joined with themselves
    placed = full.join(_sent(many), "node", "left").select(F.coalesce("cl", "node").alias("cl"), F.col("cl").isNull().alias("lone"), F.coalesce("low", "n").alias("low"), F.coalesce("high", "n").alias("high"), "tokens")
    matrix = materialise(_matrix(placed, partitions), "shingle-matrix")
    drop_table(full)
    x, y = (matrix.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("cl", "lone", "low", "high", "at"))) for s in "ab")
    # of two lone nodes the smaller set, of n tokens, has a common one among its first n - 8/9 n, as a link takes 8/9 n common ones at least
    early = lambda s: f"at_{s} <= high_{s} - ({2 * NUM} * high_{s} + {NUM + DEN - 1}) div {NUM + DEN}"
    lone = F.col("lone_a") & F.col("lone_b")
    met = x.join(y, "token").where(f"cl_a < cl_b and {DEN} * high_a >= {NUM} * low_b and {DEN} * high_b >= {NUM} * low_a").where(~lone | F.expr(f"if(high_a <= high_b, {early('a')}, {early('b')})"))
    pairs = met.groupBy("cl_a", "cl_b").agg(F.count("*").alias("common"), *(F.max(f"at_{s}").alias(f"at_{s}") for s in "ab"), *(F.first(f"{c}_{s}").alias(f"{c}_{s}") for c in ("lone", "high", "low") for s in "ab"))
    # Where a group of several is involved: of two sets of m and s <= m tokens, those with less of their prefix left over share at most what their prefixes share and the
    # 0.8 m tokens after the longer prefix; a link takes 4/9 (m + s), where s is 0.8 m at least. Either group may have the larger set.
    need = lambda x, y: 20 * F.greatest(0.8 * F.col(f"high_{x}"), F.col(f"low_{y}")) - 16 * F.col(f"high_{x}")
    enough = 45 * F.col("common") >= F.least(need("a", "b"), need("b", "a")) - 1e-6
    # two lone nodes share no more than what they share up to the last common token, and what is left of each after it
    most = F.when(lone, F.col("common") + F.least(F.col("high_a") - F.col("at_a"), F.col("high_b") - F.col("at_b")) - 1).otherwise(F.least("high_a", "high_b"))
    pairs = pairs.where((lone | enough) & ((NUM + DEN) * most >= NUM * (F.col("low_a") + F.col("low_b"))))
    pairs = materialise(pairs.select("cl_a", "cl_b", lone.alias("lone")), "shingle-pairs")
    drop_table(matrix)

    # the tops of each pair are compared
    tops = materialise(pairs.select(F.explode(F.array("cl_a", "cl_b")).alias("node")).distinct(), "shingle-tops")
    lacking = nodes.join(_sent(tops), "node", "left_semi").join(_sent(near), "node", "left_anti")
    more_sets = materialise(_sets(rows, materialise(lacking, "shingle-lacking")), "shingle-more-sets")
    leads = sets.join(_sent(tops), "node", "left_semi").unionByName(more_sets)
    a, b = (leads.select(F.col("node").alias(f"cl_{s}"), F.col("set").alias(f"set_{s}")) for s in "ab")
    led = pairs.join(a, "cl_a").join(b, "cl_b").select("cl_a", "cl_b", "set_a", "set_b").mapInArrow(_alike_rows, "a long, b long")
    # rows of one id with different sets are one place in the graph
    group = many.select("node", "cl")
    twice = signed.where("n > 0").groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y")
    same = signed.where("n > 0").join(twice, "doc_id").join(group, "node", "left").select(F.col("x"), F.coalesce("cl", "node").alias("b")).join(group.withColumnRenamed("node", "x"), "x", "left").select(F.coalesce("cl", "x").alias("a"), "b")
    edges = materialise(led.unionByName(same), "shingle-edges")
    found = components(edges)

    # pairs that hold a group of several members and are not connected yet are opened whole: the smaller one's members visit the larger one's
    label = [found.select(F.col("node").alias(f"cl_{s}"), F.col("component").alias(f"comp_{s}")) for s in "ab"]
    sized = [sizes.select(F.col("top").alias(f"cl_{s}"), F.col("members").alias(f"members_{s}")) for s in "ab"]
    unmet = pairs.where("not lone")
    for part in (*label, *sized):
        unmet = unmet.join(part, part.columns[0], "left")
    unmet = unmet.where("coalesce(comp_a, cl_a) <> coalesce(comp_b, cl_b)")
    a_hosts = F.coalesce("members_a", F.lit(1)) >= F.coalesce("members_b", F.lit(1))
    visits = unmet.select(F.when(a_hosts, F.col("cl_a")).otherwise(F.col("cl_b")).alias("host"), F.when(a_hosts, F.col("cl_b")).otherwise(F.col("cl_a")).alias("cl"), F.greatest(F.coalesce("members_a", F.lit(1)), F.coalesce("members_b", F.lit(1))).alias("members"))
    visits = materialise(visits, "shingle-visits")
    if not visits.isEmpty():
        every = sets.join(group, "node").unionByName(more_sets.withColumn("cl", F.col("node"))).unionByName(sets.withColumn("cl", F.col("node")).join(group.select("node"), "node", "left_anti"))
        more = materialise(_visited(visits, every), "shingle-more")
        if not more.isEmpty():
            found = components(edges.unionByName(more))

    # of each component the smallest document
    place = nodes.select("node", "s2", "doc_id").join(group, "node", "left").withColumn("cl", F.coalesce("cl", "node")).join(found.withColumnRenamed("node", "cl"), "cl", "left").select("node", "s2", "doc_id", F.coalesce("component", "cl").alias("comp"))
    least = place.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = materialise(place.join(least, "comp").select("node", "s2", "component_id"), "shingle-components")
    out = signed.where("n > 0").join(named, ["node", "s2"]).select("doc_id", "n", "component_id")
    other = out.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    empty = signed.where("n = 0").select("doc_id", "n").join(other, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return out.unionByName(empty).select(back("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), back("component_id"))
