"""Repair of the structure of conversations by signature deduplication.

A conversation's rows become a signature, one letter for each: the role's initial (x for others) as a small letter, as a capital one if the
text is truncated, or - where the row must go. What is cheapest depends on the signature alone, so each different one is solved once, by memoised recursion
over its suffixes; the edits are joined back to the conversations and replayed on their rows.

Rows are dealt by ranges of conversation and turn, so that a conversation, however long, is spread over tasks, in pieces of
at most PIECE_ROWS rows and about PIECE_BYTES of text; what comes together for a whole conversation is its signature, a byte for each row.
The digest of a repaired text runs over its pieces in order, as digests must, one piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm._store import materialise, sent

SPACES = " \t\n\x0b\x0c\r"
RIGHT = ("su", "ua", "au")
PIECE_ROWS, PIECE_BYTES = 20_000, 4 << 20
#: Costs of the edits, and of a truncated row that stays.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Letters of a signature that one recursion goes through.
BLOCK = 200
NEVER = 1 << 60
#: What is said so far: nothing, s, and u or a last. A state's next role, and the state after it.
NEXT, AFTER = "uuau", (2, 2, 3, 2)
LETTERS = "0123456789abcdefghijklmnopqrstuvwxyz"


def relaxed(f: tuple[int, ...]) -> tuple[int, ...]:
    """f: the cost of the rest by state. The same where rows may be inserted first: two at most, as a third comes back to a state."""
    u, a = min(f[2], INSERT + f[3]), min(f[3], INSERT + f[2])
    return min(f[0], INSERT + u), min(f[1], INSERT + u), u, a


END = relaxed((0, NEVER, NEVER, 0))


def _options(letter: str, state: int, rest: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """(edit, cost with the rest, state after) for a row, by initial."""
    out = [("D", DELETE + rest[state], state)]
    if letter != "-":
        role, extra = letter.lower(), TRUNCATED * letter.isupper()
        if role == NEXT[state]:
            out.append(("K", extra + rest[AFTER[state]], AFTER[state]))
        elif role == "s" and state == 0:
            out.append(("K", extra + rest[1], 1))
        out.append(("R", extra + RENAME + rest[AFTER[state]], AFTER[state]))
    return out


@lru_cache(1 << 17)
def cheapest(letters: str, rest: tuple[int, ...]) -> tuple[int, ...]:
    """Costs by state of letters and what follows, whose costs are rest."""
    if not letters:
        return rest
    then = cheapest(letters[1:], rest)
    return relaxed(tuple(min(c for _, c, _ in _options(letters[0], q, then)) for q in range(4)))


def solve(signature: str) -> tuple[int, str, str]:
    """(cost, audit, plan) of the cheapest edits, of equal ones the least in ASCII. The plan has a letter for each row and one for the end: the state before it, the
    rows inserted before it, and its own edit."""
    blocks = [signature[i : i + BLOCK] for i in range(0, len(signature), BLOCK)]
    rests, cost = [END], 0
    for b in reversed(blocks):
        f = cheapest(b, rests[-1])
        low = min(f)
        cost += low
        rests.append(tuple(min(x - low, NEVER) for x in f))  # from the least, so that alike blocks meet in the memory
    audit, plan, q = [], [], 0
    cost += rests[-1][0]

    for b, rest in zip(blocks, reversed(rests[:-1]), strict=True):
        for i, letter in enumerate(b):
            here, then = cheapest(b[i:], rest), cheapest(b[i + 1 :], rest)
            before, n = q, 0
            while True:
                options = [*_options(letter, q, then), ("I", INSERT + here[AFTER[q]], AFTER[q])]
                edit, _, to = min(options, key=lambda o: (o[1], o[0]))
                q = to
                audit.append(edit)
                if edit != "I":
                    break
                n += 1
            plan.append(LETTERS[before * 9 + n * 3 + "DKR".index(edit)])
    before, n = q, 0
    while q not in (0, 3):
        audit.append("I")
        q, n = AFTER[q], n + 1
    plan.append(LETTERS[before * 9 + n * 3])
    return cost, "".join(audit), "".join(plan)


def replayed(plan: str, roles: list[str], texts: list[str]) -> list[str]:
    """The repaired lines of some rows; a plan of one letter more than rows ends the conversation."""
    names, out = {"u": "user", "a": "assistant"}, []
    for i, x in enumerate(plan):
        q, rest = divmod(LETTERS.index(x), 9)
        n, edit = divmod(rest, 3)
        for _ in range(n):
            out.append(names[NEXT[q]] + ":")
            q = AFTER[q]
        if i < len(roles) and edit:
            out.append((roles[i] if edit == 1 else names[NEXT[q]]) + ":" + texts[i])
    return out


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv (the conversation's key, never null), id, turn, role, text, gone, times: rows as damaged by crc32 of id:turn modulo 20. Nulls count as one space."""
    ident, turn = F.col(id_col).cast("string"), F.col(turn_col).cast("long")
    space = F.lit(" ")
    fault = F.crc32(F.concat(F.coalesce(ident, space), F.lit(":"), F.coalesce(turn.cast("string"), space)).cast("binary")) % 20
    text, role = F.coalesce(F.col(text_col), space), F.coalesce(F.col(role_col), space)
    return rows.select(
        F.coalesce(F.concat(F.lit("="), ident), F.lit("")).alias("conv"),
        F.col(id_col).alias("id"),
        turn.alias("turn"),
        F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fault == 0).alias("gone"),
        F.when(fault == 3, 2).otherwise(1).alias("times"),
    )


_PIECE = "conv string, part long, no long, n long, signature string, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, turn0 long, turn1 long, roles array<string>, texts array<string>"


def pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """rows (as of damaged) in pieces of conversations, materialised."""
    here = rows.withColumn("h", F.md5(F.col("text").cast("binary")))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    # where what is said more than once is said first
    said = here.where(~F.col("gone")).groupBy("conv", "role", "h").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").select("conv", "role", "h", "first")
    here = here.join(sent(materialise(said, "conv-said")), ["conv", "role", "h"], "left").withColumn("again", F.coalesce(F.col("first") < order, F.lit(False)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv", "gone", "turn", "role", "h"]  # rows that are dropped come last
    dealt = here.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("conv", "turn", "role", "text", "h", "gone", "times", "again")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no, now, size, done = TaskContext.get().partitionId(), 0, None, 0, []
        names = [x.split()[0] for x in _PIECE.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 5, pa.list_(pa.string()), pa.list_(pa.string())]

        def closed() -> None:
            nonlocal no
            turns = [t for t in now["turns"] if t is not None]
            letters, initials = now["letters"], [r[:1] or " " for r in now["roles"]]
            illegal = sum(a + b not in RIGHT for a, b in zip(initials, initials[1:], strict=False))
            done.append((now["conv"], part, no, len(letters), "".join(letters), now["blank"], now["duplicate"], now["truncated"], illegal, initials[0] if initials else None, initials[-1] if initials else None, min(turns, default=None), max(turns, default=None), len(set(turns)), turns[0] if turns else None, turns[-1] if turns else None, now["roles"], now["texts"]))
            no += 1

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        last, held = None, 0
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now["conv"] != r["conv"] or len(now["letters"]) >= piece_rows or size >= PIECE_BYTES:
                    if now is not None:
                        closed()
                        held += size
                        if len(done) >= 500 or held >= PIECE_BYTES:
                            yield batch_of(done)
                            done, held = [], 0
                    now, size = {"conv": r["conv"], "letters": [], "roles": [], "texts": [], "turns": [], "blank": 0, "duplicate": 0, "truncated": 0}, 0
                if r["gone"]:
                    continue
                key = (r["conv"], r["turn"], r["role"], r["h"])
                bare = r["text"].rstrip(SPACES)
                for k in range(r["times"]):
                    x = r["role"][:1] if r["role"][:1] in ("s", "u", "a") else "x"
                    if not bare:
                        now["blank"] += 1
                        x = "-"
                    elif r["again"] or k or key == last:
                        now["duplicate"] += 1
                        x = "-"
                    elif bare[-1] not in ".!?":
                        now["truncated"] += 1
                        x = x.upper()
                    now["letters"].append(x)
                    now["roles"].append(r["role"])
                    now["texts"].append(r["text"])
                    now["turns"].append(r["turn"])
                    size += len(r["text"]) + 50
                last = key
        if now is not None:
            closed()
        if done:
            yield batch_of(done)

    return materialise(dealt.mapInArrow(cut, _PIECE), "conv-pieces")


def solved(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit, plan for each different signature."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = [solve(s) for s in rows.signature]
            yield pd.DataFrame({"signature": rows.signature, "cost": [g[0] for g in got], "audit": [g[1] for g in got], "plan": [g[2] for g in got]})

    return signatures.select("signature").distinct().mapInPandas(each, "signature string, cost long, audit string, plan string")


_FOUND = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """rows as of damaged (others may be given, with gone false and times 1). One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. Its rows are taken by turn, nulls first; those of one turn by role, then by a digest of the text, equal ones together."""
    cut = pieces(rows, piece_rows)
    facts = cut.drop("roles", "texts")
    w = W.partitionBy("conv").orderBy("part", "no")
    full = F.col("n") > 0
    # a piece has what stands before it: no more pieces of a conversation than thousands of its rows
    facts = facts.withColumn("at", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n"))
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    facts = facts.withColumn("before", F.last(F.when(full, F.col("last")), ignorenulls=True).over(earlier)).withColumn("turn_before", F.last("turn1", ignorenulls=True).over(earlier))
    seam = F.when(full & F.col("before").isNotNull() & ~F.concat("before", "first").isin(*RIGHT), 1).otherwise(0)
    same = F.when(F.col("turn0") == F.col("turn_before"), 1).otherwise(0)
    letters = F.transform(F.array_sort(F.collect_list(F.struct("part", "no", "signature"))), lambda x: x["signature"])
    whole = facts.groupBy("conv").agg(
        F.array_join(letters, "").alias("signature"),
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - same), F.lit(0)).cast("long").alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        F.sum(F.col("illegal") + seam).alias("illegal"),
        F.count("*").alias("n_pieces"),
    )
    whole = materialise(whole, "conv-signatures")
    plans = whole.join(solved(whole), "signature").select("conv", "n_pieces", F.length("signature").alias("n_rows"), "plan", *_FOUND)
    ids = rows.groupBy("conv").agg(F.first("id").alias("id"))
    plans = materialise(plans.join(ids, "conv"), "conv-plans")
    # each piece with its part of the plan; the last one has the end's letter too
    places = facts.select("conv", "part", "no", "at")
    mine = plans.join(places, "conv").join(cut.select("conv", "part", "no", "n", "roles", "texts"), ["conv", "part", "no"])
    ends = (F.col("at") + F.col("n") == F.col("n_rows")) & (F.col("n") > 0)
    piece = F.expr("substring(plan, cast(at + 1 as int), cast(n + 1 as int))")
    mine = mine.select("conv", "part", "no", "n_pieces", F.when(ends, piece).otherwise(F.expr("substring(plan, cast(at + 1 as int), cast(n as int))")).alias("plan"), "roles", "texts")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, part, no, count = (batch.column(i) for i in range(4))
            text, sha = [], []
            for i in range(batch.num_rows):
                lines = replayed(batch.column(4)[i].as_py(), batch.column(5)[i].as_py(), batch.column(6)[i].as_py())
                one = count[i].as_py() == 1
                text.append(None if one or not lines else "\n".join(lines))
                sha.append(hashlib.sha256("\n".join(lines).encode()).hexdigest() if one else None)
            yield pa.RecordBatch.from_arrays([conv, part, no, pa.array(text, pa.string()), pa.array(sha, pa.string())], names=["conv", "part", "no", "text", "sha"])

    done = materialise(mine.mapInArrow(replay, "conv string, part long, no long, text string, sha string"), "conv-repaired")
    long = done.where("sha is null").repartition("conv").sortWithinPartitions("conv", "part", "no")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x, any_ = None, None, False
        out = lambda c, x: pa.RecordBatch.from_arrays([pa.array([c], pa.string()), pa.array([x.hexdigest()])], names=["conv", "sha"])
        for batch in batches:
            for r in batch.select(["conv", "text"]).to_pylist():
                if r["conv"] != now:
                    if now is not None:
                        yield out(now, x)
                    now, x, any_ = r["conv"], hashlib.sha256(), False
                if r["text"] is not None:
                    x.update((("\n" if any_ else "") + r["text"]).encode())
                    any_ = True
        if now is not None:
            yield out(now, x)

    shas = done.where("sha is not null").select("conv", "sha").unionByName(long.mapInArrow(digest, "conv string, sha string"))
    return plans.join(shas, "conv").select("id", *_FOUND, F.col("sha").alias("repaired_sha256"))


def repair_report(conversations: DataFrame) -> DataFrame:
    """The repair of conversations damaged on purpose, as conv_id, gaps and so on; one row per conv_id, a null one included. Null turns are
    rows like others, only without a turn for gaps; null roles and texts count as one space."""
    return repair(damaged(conversations)).withColumnRenamed("id", "conv_id")
