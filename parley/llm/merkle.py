"""A Merkle manifest of a dataset by superblock reduction.

Leaves are numbered within their source by a range partition and prefix sums over its parts' counts, so that no source is one task.
Their numbers are bucketed by fanout**levels; one task collapses the levels of a bucket to a node, the nodes of all buckets are
numbered by their bucket and collapsed again, until a source has one node. The sources' nodes are reduced likewise. On the way back down
each bucket gets its upper proof, the siblings above it, once, and its members put their own below it: no proof is moved for
every leaf, and a task holds fanout**levels hashes and one upper proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm._store import drop_table, materialise

FANOUT = 16
#: Levels that one bucket collapses: 16**2 leaves.
LEVELS = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(columns: list[Column]) -> Column:
    """The digest of a row: each value as its UTF-8 byte count, a colon and itself, or - for null."""
    shown = (c.cast("string") for c in columns)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown)), 256)


def numbered(rows: DataFrame, group: str | None, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """rows as a table, with at (the place among its group's rows in ascending order, from 0) and n (the group's rows). No task sees more
    than a range of the order; rows alike in it are placed one after another in any order."""
    n_parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = [group] if group else []
    keys = [*groups, *order]
    placed = rows.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys).withColumn("__k", F.monotonically_increasing_id())  # part and place in it
    dealt = materialise(placed, name + "-dealt")
    part = F.shiftright("__k", 33)
    counts = materialise(dealt.groupBy(part.alias("__part"), *groups).agg(F.count("*").alias("__c"), F.min("__k").alias("__first")), name + "-counts")  # a row for each part and group in it
    # no more rows of a group stand in this window than there are parts
    upto = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    before = counts.select("__part", *(F.col(g).alias("__g") for g in groups), (F.sum("__c").over(upto.orderBy("__part").rowsBetween(W.unboundedPreceding, 0)) - F.col("__c") - F.col("__first")).alias("__before"), F.sum("__c").over(upto).alias("n"))
    local = dealt.withColumn("__of", part)
    on = [local["__of"] == before["__part"], *(local[g].eqNullSafe(before["__g"]) for g in groups)]
    out = materialise(local.join(before, on).select(*(local[c] for c in rows.columns), (F.col("__before") + F.col("__k")).alias("at"), "n"), name)
    drop_table(dealt)
    drop_table(counts)
    return out


def collapse(hashes: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes of each level of one bucket, the given ones first."""
    out = [hashes]
    for _ in range(levels):
        last = out[-1]
        out.append([h("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return out


def paths(levels: list[list[str]], fanout: int = FANOUT) -> list[tuple[list[str], list[str]]]:
    """For each node of the first level, what stands before and after it and its ancestors in their runs, level by level."""
    out = []
    for i in range(len(levels[0])):
        before, after = [], []
        for nodes in levels[:-1]:
            run = i // fanout * fanout
            before.append("".join(nodes[run:i]))
            after.append("".join(nodes[i + 1 : run + fanout]))
            i //= fanout
        out.append((before, after))
    return out


def folded(node: str, before: list[str], after: list[str]) -> str:
    for b, a in zip(before, after, strict=True):
        node = h(b + node + a)
    return node


_BUCKET = "tree string, bucket long, n long, depth int, hashes array<string>, node string"
_PATH = "tree string, at long, before array<string>, after array<string>"


def _round(nodes: DataFrame, levels: int, fanout: int, name: str) -> DataFrame:
    """nodes: tree (null allowed), at, n, depth (levels still above them), node. One row per bucket: its members and the node they collapse to."""
    size = fanout**levels

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        depth, hashes = int(rows["depth"].iloc[0]), rows.node.tolist()
        top = collapse(hashes, min(levels, depth), fanout)[-1]
        return pd.DataFrame({"tree": [rows.tree.iloc[0]], "bucket": [int(rows["at"].iloc[0]) // size], "n": [-(-int(rows.n.iloc[0]) // fanout ** min(levels, depth))], "depth": [depth], "hashes": [hashes], "node": [top[0]]})

    dealt = nodes.withColumn("__bucket", F.expr(f"at div {size}"))
    return materialise(dealt.groupBy("tree", "__bucket").applyInPandas(one, _BUCKET), name)


def reduce_trees(nodes: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """nodes: tree, at, n, node. The tables of all rounds, and tree, node: the root of each tree."""
    # levels above n leaves: integers, as logarithms round
    n, depth = F.col("n"), F.lit(0)
    for d in range(1, 17):
        depth = depth + F.when(n > fanout ** (d - 1), 1).otherwise(0)
    now, rounds = nodes.select("tree", "at", "n", depth.cast("int").alias("depth"), "node"), []
    while True:
        got = _round(now, levels, fanout, f"merkle-round-{len(rounds)}")
        rounds.append(got)
        if not got.where(F.col("depth") > levels).limit(1).count():
            return rounds, got.select("tree", "node") if len(rounds) == 1 else _tops(rounds, levels)
        # a tree that has one node stays out of the next round
        now = got.where(F.col("depth") > levels).select("tree", F.col("bucket").alias("at"), "n", (F.col("depth") - levels).alias("depth"), "node")


def _tops(rounds: list[DataFrame], levels: int) -> DataFrame:
    out = None
    for r in rounds:
        done = r.where(F.col("depth") <= levels).select("tree", "node")
        out = done if out is None else out.unionByName(done)
    return out


def _opened(levels: int, fanout: int):
    """Buckets with their upper proofs (tree, bucket, depth, hashes, before, after): the same for each of their members."""

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in (r for rows in batches for r in rows.itertuples(index=False)):
            own = paths(collapse(list(r.hashes), min(levels, r.depth), fanout), fanout)
            yield pd.DataFrame({"tree": [r.tree] * len(own), "at": [r.bucket * fanout**levels + i for i in range(len(own))], "before": [[*b, *r.before] for b, _ in own], "after": [[*a, *r.after] for _, a in own]})

    return down


def lower_paths(rounds: list[DataFrame], above: DataFrame, levels: int, fanout: int) -> DataFrame:
    """From the last round down to the first: each bucket of the first with its upper proof (before, after). above: tree, before, after of each root."""
    upper = None  # of the nodes that are buckets of the round below
    for k in range(len(rounds) - 1, -1, -1):
        r = rounds[k].alias("r")
        roots = r.where(F.col("depth") <= levels).join(above.alias("a"), F.expr("r.tree <=> a.tree")).select("r.*", "a.before", "a.after")
        if upper is not None:
            inner = r.where(F.col("depth") > levels).join(upper.alias("u"), F.expr("r.tree <=> u.tree and r.bucket = u.at")).select("r.*", "u.before", "u.after")
            roots = roots.unionByName(inner)
        if k == 0:
            return roots
        upper = materialise(roots.mapInPandas(_opened(levels, fanout), _PATH), f"merkle-paths-{k}")
    raise ValueError("no rounds")


def manifest(docs: DataFrame, id_col: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tree_col: str = "source", tampered: Column | None = None, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """One row per row of docs: id_col, leaf, subroot (its tree's), root, proof_sha256, folded_root, verified.

    tampered: the leaf hash that is found at verification, if not the leaf itself; null means the leaf. folded_root is
    made from it and the siblings of the manifest. Rows that share an id are leaves of their own, in the order of their digests; a
    null id stands first; a null tree is a tree of its own, the first. A null or empty value differ, as - and 0:. No rows: no result.
    """
    leaves = docs.select(F.col(id_col).alias("id"), F.col(tree_col).cast("string").alias("tree"), leaf_hash([F.col(c) for c in columns]).alias("leaf"), (F.lit(None).cast("string") if tampered is None else tampered).alias("found"))
    rows = numbered(leaves, "tree", ["id", "leaf", "found"], "merkle-leaves")
    rounds, subroots = reduce_trees(rows.select("tree", "at", "n", F.col("leaf").alias("node")), levels, fanout)
    subroots = materialise(subroots, "merkle-subroots")
    # the trees' roots are the leaves of one tree more
    tops = numbered(subroots.select(F.col("tree").alias("of"), "node"), None, ["of"], "merkle-trees")
    upper_rounds, top = reduce_trees(tops.select(F.lit(None).cast("string").alias("tree"), "at", "n", "node"), levels, fanout)
    none = F.array().cast("array<string>")
    at_top = top.select("tree", none.alias("before"), none.alias("after"))

    over = lower_paths(upper_rounds, at_top, levels, fanout).mapInPandas(_opened(levels, fanout), _PATH).alias("p")
    above = materialise(tops.alias("t").join(over, F.expr("t.at = p.at")).select(F.col("t.of").alias("tree"), "p.before", "p.after"), "merkle-above")
    buckets = lower_paths(rounds, above, levels, fanout)
    buckets = buckets.alias("b").join(subroots.alias("s"), F.expr("b.tree <=> s.tree")).select("b.*", F.col("s.node").alias("subroot")).crossJoin(top.select(F.col("node").alias("root")))  # one root
    # the leaves' own hashes come with their found ones, as arrays of a bucket
    size = fanout**levels
    members = rows.groupBy("tree", F.expr(f"at div {size}").alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("at", "id", "leaf", "found"))).alias("members"))  # at most size of them
    both = buckets.alias("b").join(members.alias("m"), F.expr("b.tree <=> m.tree and b.bucket = m.bucket")).select("m.members", "b.depth", "b.before", "b.after", "b.subroot", "b.root")
    id_type = docs.schema[id_col].dataType.simpleString()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in (r for rows in batches for r in rows.itertuples(index=False)):
            own = paths(collapse([m["leaf"] for m in r.members], min(levels, r.depth), fanout), fanout)
            upper_b, upper_a = list(r.before), list(r.after)
            above_text = "".join(b + a for b, a in zip(upper_b, upper_a, strict=True))
            out = []
            for m, (before, after) in zip(r.members, own, strict=True):
                proof = "".join(b + a for b, a in zip(before, after, strict=True)) + above_text
                root = folded(m["leaf"] if m["found"] is None else m["found"], [*before, *upper_b], [*after, *upper_a])
                out.append((m["id"], m["leaf"], r.subroot, r.root, h(proof), root, root == r.root))
            frame = pd.DataFrame(out, columns=[id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
            frame[id_col] = pd.array([x[0] for x in out], dtype="Int64") if id_type in ("bigint", "int", "smallint", "tinyint") else frame[id_col]
            yield frame

    return both.mapInPandas(verify, f"`{id_col}` {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def lower_cased(text: Column) -> Column:
    """A-Z lower-cased, as a copy of a text might be altered without notice."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def tamper_report(docs: DataFrame) -> DataFrame:
    """The manifest of documents, verified against copies whose text is lower-cased where 5 divides crc32 of the id in decimal; a null id
    has no decimal form and is left alone."""
    at = ("doc_id", "source", "lang", "n_chars")
    altered = leaf_hash([*(F.col(c) for c in at), lower_cased(F.col("text"))])
    return manifest(docs, tampered=F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, altered))
