"""Language-model scores by a hierarchical Pitman-Yor bigram model.

Each context word is a restaurant whose customers are the tokens that follow it and whose dishes are words; each of its tables sends
one customer to the parent, the unigram restaurant that all contexts share; its tables draw from a uniform base over the vocabulary and one unknown word.
Seatings are sampled by Gibbs: given all else, the customers of one dish in one restaurant are seated anew. Of a seating only the
number of tables matters to what is predicted, so that is drawn, from its exact conditional (generalised Stirling numbers) up to
EXACT customers; of more, customers are seated one after another, in blocks that grow with those seated. In a sweep the
restaurants see each other's tables, and the dishes of a restaurant the other dishes', as the sweep before left them: that is what lets all parts run at
once. The scores are of the predictive probabilities averaged over the samples kept.

Restaurants are dealt by context into parts; those of a very frequent context are dealt by context and dish, with the number of
tables of the whole context handed round; pairs that are very frequent themselves are scored where the texts are read. The bound
of very frequent is a share of all tokens (1 / SHARES at least), so both lists have at most SHARES entries. Pairs that occur once have one table,
always: they are counted, not kept. Draws depend on a hash of what is drawn, not on order or place, so a task that runs again gives the same.
Words and pairs are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm._store import drop_table, materialise, sent
from parley.llm._text import IS_SPACE, LOWER, PLACE, U64, give_back, mix, prefix_hash, runs, slices, span_hash

#: The end of a text, a token and the context of the next text's first word.
END = mix(np.full(1, 0xE0D, U64))[0]
#: Bytes of text that a task takes together.
TAKEN = 1 << 23
#: Tokens in one part, about, and the least share of all tokens that a context or pair needs to be dealt otherwise.
PART_TOKENS, SHARES = 2_500_000, 100_000
#: Words among which those are that are written as slots, and pairs that are scored together.
COMMON, TOGETHER = 1 << 16, 100_000
#: Logarithms of the parent's probabilities are moved as multiples of this, two in 64 bits.
LOG_UNIT = 2.0**-26
#: Sums of scores are moved as multiples of this.
UNIT = 2.0**-32
BURN_IN, SAMPLES = 1, 3
STRENGTH = 1.0
#: Customers of a dish up to which the number of tables is drawn exactly.
EXACT = 64
_MESSAGE = "kind int, part long, key long, n long, m long, a binary, b binary, c binary, d binary"
RESTAURANT, DISH, HOT_PAIR, COUNTS, CONTEXTS, HOT_TABLES, SEATING, HEADER = range(8)


def packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True) if len(x) else b""


def unpacked(x: bytes | None, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def packed_small(x: np.ndarray) -> bytes:
    """Numbers of two bytes where they fit, else of four."""
    wide = np.uint32 if len(x) and int(x.max()) >= 1 << 16 else np.uint16
    return bytes([np.dtype(wide).itemsize]) + packed(x.astype(wide))


def unpacked_small(x: bytes, n: int) -> np.ndarray:
    return unpacked(x[1:], np.uint16 if x[0] == 2 else np.uint32, n).astype(np.int64)


class Code:
    """Hashes of words as bytes: frequent words as a slot of 16 bits, before compression, others as their 64. A slot has the most frequent of the words whose hash
    begins with it."""

    def __init__(self, common: np.ndarray):
        """common: hashes, the most frequent first."""
        self.slots = np.zeros(1 << 16, U64)
        self.slots[(common[::-1] >> U64(48)).astype(np.int64)] = common[::-1]
        self.slots[0] = 0  # stands for the others

    def packed(self, x: np.ndarray) -> bytes:
        slot = (x >> U64(48)).astype(np.uint16)
        there = (self.slots[slot] == x) & (slot > 0)
        body = np.where(there, slot, 0).astype(np.uint16).tobytes() + x[~there].tobytes()
        return len(body).to_bytes(4, "little") + pa.compress(body, "zstd", asbytes=True)

    def unpacked(self, b: bytes, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0, U64)
        body = pa.decompress(b[4:], int.from_bytes(b[:4], "little"), "zstd", asbytes=True)
        slot = np.frombuffer(body, np.uint16, n)
        out = self.slots[slot]
        out[slot == 0] = np.frombuffer(body, U64, offset=2 * n)
        return out


def pair_key(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(ctx * PLACE[0] + word * PLACE[1])


def placed(h: np.ndarray) -> np.ndarray:
    """The places of hashes in order of their leading bits; those of equal ones stay in order. Each hash is sorted as a number that has its place in place of its
    last bits: numbers are sorted several times faster than places by numbers."""
    low = U64((1 << max(1, len(h) - 1).bit_length()) - 1)
    both = h & ~low
    both |= np.arange(len(h), dtype=U64)
    both.sort()
    both &= low
    return both.view(np.int64)


def in_order(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(np.argsort of hashes, stable; the hashes in that order)."""
    order = placed(h)
    got = h[order]
    wrong = np.flatnonzero(got[1:] < got[:-1])
    if len(wrong) > 1000:
        order = np.argsort(h, kind="stable")
        return order, h[order]
    if len(wrong):  # different hashes with the same leading bits
        low = U64((1 << max(1, len(h) - 1).bit_length()) - 1)
        lead = got & ~low
        for x in np.unique(lead[wrong]):
            lo, hi = np.searchsorted(lead, x), np.searchsorted(lead, x, "right")
            order[lo:hi] = order[lo:hi][np.argsort(got[lo:hi], kind="stable")]
        got = h[order]
    return order, got


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order of key, the places in it where a new value begins)."""
    order, got = in_order(key)
    return order, np.flatnonzero(np.diff(got, prepend=~got[:1])) if len(key) else order


def sums(x: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x[order], first) if len(first) else np.zeros(0, np.int64)


def tokens_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, tokens, their contexts, their texts from 0) of runs of whole texts; each text ends with END."""
    lo, size, held = 0, 0, []
    for _, hi, data, offs in slices(texts):
        low = LOWER[data]
        start, end, first = runs(~IS_SPACE[low], offs)
        count = np.diff(first) + 1
        tokens = np.full(int(count.sum()), END, U64)
        inner = np.ones(len(tokens), bool)
        inner[np.cumsum(count) - 1] = False
        tokens[inner] = span_hash(prefix_hash(low), start, end)
        held.append((tokens, count))
        size += len(data)
        if size >= TAKEN or hi == len(texts):
            tokens, count = (np.concatenate(x) for x in zip(*held, strict=True))
            yield lo, hi, tokens, np.concatenate([[END], tokens[:-1]]), np.repeat(np.arange(hi - lo), count)
            lo, size, held = hi, 0, []


def messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 4)
    rows = [(*r, *[None] * (9 - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _MESSAGE.split(", ")])


def dishes(kind: int, part: int, key: np.ndarray, n: np.ndarray, m: np.ndarray | None = None) -> pa.RecordBatch:
    """Many messages that hold numbers alone."""
    size, none = len(key), pa.nulls(len(key), pa.binary())
    m = np.zeros(size, np.int64) if m is None else m
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), pa.array(np.full(size, part)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(m.astype(np.int64)), none, none, none, none], names=[x.split()[0] for x in _MESSAGE.split(", ")])


def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for discount d, t from 1 (column 0), c up to most."""
    out = np.full((most + 1, most), -np.inf)
    out[1, 0] = 0
    t = np.arange(1, most + 1)
    for c in range(1, most):
        stay = np.log(np.maximum(c - t * d, 1e-300)) + out[c]
        out[c + 1] = np.logaddexp(stay, np.concatenate([[-np.inf], out[c, :-1]]))
    return out


def uniform(key: np.ndarray, *at: int) -> np.ndarray:
    """Numbers from 0 to 1 that depend on key and at alone."""
    h = key
    for x in at:
        h = mix(h ^ mix(np.full(1, x + 1, U64)))
    return (h >> U64(11)).astype(float) * 2.0**-53


def tables(c: np.ndarray, others: np.ndarray, p: np.ndarray, key: np.ndarray, sweep: int, d: float, strength: float = STRENGTH) -> np.ndarray:
    """Numbers of tables at which c customers of a dish sit, drawn given the restaurant's other tables and the parent's probability of the dish."""
    out, s = np.ones(len(c), np.int64), stirling(d)
    order = np.argsort(c, kind="stable")
    edges = np.searchsorted(c[order], np.arange(2, EXACT + 2))
    for k in range(2, EXACT + 1):
        for lo in range(edges[k - 2], edges[k - 1], 1 + 500_000 // k):
            at = order[lo : min(lo + 1 + 500_000 // k, edges[k - 1])]
            j = np.arange(k)
            w = s[k, :k] + np.cumsum(np.log(strength + d * (others[at, None] + j)), 1) + (j + 1) * np.log(p[at])[:, None]
            w = np.cumsum(np.exp(w - w.max(1, keepdims=True)), 1)
            out[at] = 1 + (w < (uniform(key[at], sweep, 0) * w[:, -1])[:, None]).sum(1)
    at, seated, step = order[edges[-1] :], 1, 0
    t = np.ones(len(at))
    while len(at):
        step += 1
        block = np.minimum(max(1, seated // 50), c[at] - seated)
        new = (strength + d * (others[at] + t)) * p[at]
        t += np.floor(block * new / (new + seated - d * t) + uniform(key[at], sweep, step))  # of one customer, that is a throw of a coin
        seated += max(1, seated // 50)
        done = c[at] <= seated
        out[at[done]] = t[done]
        at, t = at[~done], t[~done]
    return np.minimum(out, c)


def _texts(docs: DataFrame, id_col: str, text_col: str, hold_out: tuple[int, int]) -> DataFrame:
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % hold_out[0] == hold_out[1]
    return docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held"), F.col(text_col).alias("text"))


def count_words(texts: DataFrame) -> DataFrame:
    """w, n (its tokens), c (of those, in training), materialised. Words are moved by ranges of their hashes, those of a run of texts packed."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, tokens, _, text in tokens_of(batch.column(1)):
                order, first = grouped(tokens)
                n = np.diff(first, append=len(order))
                c = sums((~held[lo + text]).astype(np.int64), order, first)
                w = tokens[order[first]]
                part = ((w >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
                edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
                yield messages([(COUNTS, int(part[a]), int(b - a), 0, 0, packed(w[a:b]), packed_small(n[a:b]), packed_small(c[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)])

    def merge(group: pa.Table) -> pa.Table:
        rows = [(unpacked(r["a"], U64, r["key"]), unpacked_small(r["b"], r["key"]), unpacked_small(r["c"], r["key"])) for r in group.select(["key", *"abc"]).to_pylist()]
        w, n, c = (np.concatenate(x) for x in zip(*rows, strict=True))
        order, first = grouped(w)
        out = pa.table({"w": w[order[first]].view(np.int64), "n": sums(n, order, first), "c": sums(c, order, first)})
        give_back()
        return out

    dealt = texts.select("held", "text").mapInArrow(count, _MESSAGE)
    return materialise(dealt.repartition(parts, "part").groupBy("part").applyInArrow(merge, "w long, n long, c long"), "lm-words")


class Deal:
    """Where pairs go: the number of parts, and the contexts (sorted) whose pairs are dealt by themselves, with their customers."""

    def __init__(self, parts: int, hot: np.ndarray, customers: np.ndarray, least: int, code: Code):
        self.parts, self.hot, self.customers, self.least, self.code = parts, hot, customers, least, code

    def is_hot(self, ctx: np.ndarray) -> np.ndarray:
        return among(self.hot, ctx)[1]

    def dealt(self, ctx: np.ndarray, key: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(part, its places) of the pairs at of, in an order that brings the pairs of a context together, and equal ones (or nearly all:
        what is dealt may hold a pair twice). Parts are ranges of hashes, so one sort does all."""
        own = key[of]
        if (own[1:] < own[:-1]).any():
            of = of[in_order(own)[0]]
        hot = self.is_hot(ctx[of])
        for at, h in ((of[~hot], mix(ctx[of[~hot]])), (of[hot], key[of[hot]])):
            order = placed(h)  # the pairs of a context stay in order of their keys
            part = ((h[order] >> U64(32)) * U64(self.parts) >> U64(32)).astype(np.int64)
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                yield int(part[lo]), at[order[lo:hi]]


def among(known: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted array known, whether they are there)."""
    if not len(known):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return at, known[at] == x


class Known:
    """among, for many looks into the same array of hashes: those that begin alike are a few, one after another."""

    def __init__(self, known: np.ndarray):
        bits = min(24, max(1, len(known).bit_length()))
        self.known, self.shift = known, U64(64 - bits)
        self.start = np.minimum(np.searchsorted(known, np.arange(1 << bits, dtype=U64) << self.shift), max(0, len(known) - 1))

    def among(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known):
            return among(self.known, x)
        at = self.start[x >> self.shift]
        left = np.flatnonzero((self.known[at] < x) & (at < len(self.known) - 1))
        while len(left):
            at[left] += 1
            left = left[(self.known[at[left]] < x[left]) & (at[left] < len(self.known) - 1)]
        return at, self.known[at] == x


def build(texts: DataFrame, deal: Deal) -> DataFrame:
    """The restaurants of each part, materialised: messages of the kinds RESTAURANT (contexts, dishes, customers of the pairs kept), CONTEXTS (all contexts with
    the pairs not kept), DISH (each word of the part, its pairs not kept, its pairs kept), HOT_PAIR, HOT_TABLES, COUNTS (pairs of one and of two customers)."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, tokens, ctx, text in tokens_of(batch.column(1)):
                key = pair_key(ctx, tokens)
                order, first = grouped(key)
                at = order[first]
                n, c = np.diff(first, append=len(order)).astype(np.uint32), sums((~held[lo + text]).astype(np.uint32), order, first).astype(np.uint32)
                ctx, word, key = ctx[at], tokens[at], key[at]
                yield messages([(RESTAURANT, p, len(x), 0, 0, deal.code.packed(ctx[x]), deal.code.packed(word[x]), packed(n[x]), packed(c[x])) for p, x in deal.dealt(ctx, key, np.arange(len(at)))])
            give_back()

    def merge(group: pa.Table) -> pa.Table:
        rows = [(*(deal.code.unpacked(r[x], r["key"]) for x in "ab"), *(unpacked(r[x], np.uint32, r["key"]) for x in "cd")) for r in group.select(["key", *"abcd"]).to_pylist()]
        part = group.column("part")[0].as_py()
        ctx, word, n, c = (np.concatenate(x) for x in zip(*rows, strict=True))
        order, first = grouped(pair_key(ctx, word))
        n, c, at = sums(n.astype(np.int64), order, first), sums(c.astype(np.int64), order, first), order[first]
        ctx, word = ctx[at], word[at]
        keep, single = (c >= 2) | ((c == 1) & (n > 1)), (c == 1) & (n == 1)
        order, first = grouped(ctx)
        names, guests, singles = ctx[order[first]], sums(c, order, first), sums(single.astype(np.int64), order, first)
        names, guests, singles = names[guests > 0], guests[guests > 0], singles[guests > 0].astype(np.uint32)
        kept = order[keep[order]]  # by context
        order, first = grouped(word)
        words, alone, together = word[order[first]], sums(single.astype(np.int64), order, first), sums(keep.astype(np.int64), order, first)
        out = [messages([(RESTAURANT, part, int(keep.sum()), 0, 0, deal.code.packed(ctx[kept]), deal.code.packed(word[kept]), packed(c[kept].astype(np.uint32))), (CONTEXTS, part, len(names), 0, 0, deal.code.packed(names), packed(singles), packed(guests)), (COUNTS, part, 0, int((c == 1).sum()), int((c == 2).sum()))])]
        out.append(dishes(DISH, part, words, alone, together))
        hot = np.flatnonzero(n > deal.least)
        out.append(messages([(HOT_PAIR, part, int(np.int64(ctx[i].view(np.int64))), int(c[i]), int(word[i].view(np.int64))) for i in hot]))
        common = deal.is_hot(names)
        out.append(dishes(HOT_TABLES, part, names[common], singles[common]))
        give_back()
        return pa.Table.from_batches(out)

    dealt = texts.select("held", "text").mapInArrow(pairs, _MESSAGE)
    return materialise(dealt.repartition(deal.parts, "part").groupBy("part").applyInArrow(merge, _MESSAGE), "lm-restaurants")


class Part:
    """The restaurants of a part: kept pairs (sorted by context), all contexts, and the tables of each kept pair."""

    def __init__(self, group: pa.Table, code: Code):
        rows = group.filter(pc.is_in(group.column("kind"), pa.array([RESTAURANT, CONTEXTS, SEATING], pa.int32()))).to_pylist()
        self.ctx = self.word = self.names = np.zeros(0, U64)
        self.c = self.singles = self.customers = np.zeros(0, np.int64)
        self.t: dict[int, np.ndarray] = {}
        for r in rows:
            n = r["key"]
            if r["kind"] == RESTAURANT:
                self.ctx, self.word, self.c = code.unpacked(r["a"], n), code.unpacked(r["b"], n), unpacked(r["c"], np.uint32, n).astype(np.int64)
            elif r["kind"] == CONTEXTS:
                self.names, self.singles, self.customers = code.unpacked(r["a"], n), unpacked(r["b"], np.uint32, n).astype(np.int64), unpacked(r["c"], np.int64, n)
            else:
                self.t[r["m"]] = unpacked(r["a"], np.uint32, n).astype(np.int64)
        self.own = np.searchsorted(self.names, self.ctx)

    def all_tables(self, t: np.ndarray, hot: np.ndarray, hot_tables: np.ndarray) -> np.ndarray:
        """Of each context: all its tables, also those in other parts."""
        out = self.singles + np.bincount(self.own, t, len(self.names)).astype(np.int64)
        at, there = among(hot, self.names)
        out[there] = hot_tables[at[there]]
        return out


def sweep(restaurants: DataFrame, seatings: DataFrame | None, parent: DataFrame, deal: Deal, hot_tables: np.ndarray, hot_pairs: np.ndarray, number: int, d: float, strength: float) -> DataFrame:
    """All kept pairs seated anew, materialised: messages SEATING (tables of a part's pairs), DISH (a word's tables in the part), HOT_TABLES, HOT_PAIR."""
    hot = deal.hot

    def seat(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([messages([])])
        x, part = Part(left, deal.code), left.column("part")[0].as_py()
        words, p = right.column("w").to_numpy().view(U64), right.column("p").to_numpy()
        order = np.argsort(words)
        words, p = words[order], p[order]
        t = next(iter(x.t.values()), np.ones(len(x.c), np.int64)).copy()
        many = np.flatnonzero(x.c >= 2)
        total = x.all_tables(t, hot, hot_tables)
        key = pair_key(x.ctx, x.word)
        t[many] = tables(x.c[many], total[x.own[many]] - t[many], p[Known(words).among(x.word[many])[0]], key[many], number, d, strength)
        order, first = grouped(x.word)
        common = np.flatnonzero(deal.is_hot(x.names))
        frequent = np.flatnonzero(among(hot_pairs, key)[1])
        own = np.bincount(x.own, t, len(x.names)).astype(np.int64)
        out = [messages([(SEATING, part, len(t), 0, number, packed(t.astype(np.uint32)))]), dishes(DISH, part, x.word[order[first]], sums(t, order, first)), dishes(HOT_TABLES, part, x.names[common], own[common] + x.singles[common]), dishes(HOT_PAIR, part, key[frequent], t[frequent])]
        give_back()
        return pa.Table.from_batches(out)

    left = restaurants.where(F.col("kind").isin(RESTAURANT, CONTEXTS))
    left = left if seatings is None else left.unionByName(seatings)
    asked = restaurants.where((F.col("kind") == DISH) & (F.col("m") > 0)).select(F.col("part").alias("of"), F.col("key").alias("w"))
    answers = asked.join(sent(parent.select("w", "p")).hint("shuffle_hash"), "w").select("of", "w", "p")
    return materialise(left.groupBy("part").cogroup(answers.groupBy("of")).applyInArrow(seat, _MESSAGE), f"lm-sweep-{number}")


class Parent:
    """The unigram restaurant: a table of w, c (customers, one for each table of a context's restaurant), t (tables), p (probability) of
    the words that have or may come to have more than one customer; the others (alone of them) have one, and probability single."""

    def __init__(self, customers: DataFrame, alone: int, before: Parent | None, number: int, vocabulary: int, strength: float):
        base = 1 / (vocabulary + 1)
        if before is None:
            few = customers.agg(F.count_if(F.col("c") == 1).alias("a"), F.count_if(F.col("c") == 2).alias("b")).first()
            self.d = discount(few["a"] + alone, few["b"])
            seen, total = customers.select("w", "c", F.lit(1).cast("long").alias("t")), None
        else:
            self.d, total = before.d, before.tables
            rows = customers.select("w", "c", F.lit(0).cast("long").alias("t")).unionByName(before.frame.select("w", F.lit(0).cast("long").alias("c"), "t"))
            seen = rows.groupBy("w").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
        d = self.d

        def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w, c, t = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
                t = np.ones(len(w), np.int64) if total is None else tables(c, total - t, np.full(len(w), base), mix(w.view(U64)), number, d, strength)
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(c), pa.array(t)], names=["w", "c", "t"])

        made = materialise(seen.select("w", "c", "t").mapInArrow(seat, "w long, c long, t long"), f"lm-parent-{number}")
        whole = made.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
        self.made, self.tables, guests = made, whole["t"] + alone, strength + whole["c"] + alone
        self.rest = (strength + d * self.tables) / guests * base  # what a word that has no customer gets, too
        self.single = (1 - d) / guests + self.rest
        self.frame = made.withColumn("p", (F.col("c") - d * F.col("t")) / guests + self.rest)


def discount(ones: int, twos: int) -> float:
    """From the numbers of dishes with one and with two customers (Kneser and Ney's estimate)."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def _common(words: DataFrame) -> np.ndarray:
    """The most frequent words, the most frequent first: those over a number of tokens that COMMON words at most have, by a histogram of a few hundred classes."""
    kind = F.floor(F.log2("n") * 16).cast("long")
    classes, over, least = sorted(((r["k"], r["x"]) for r in words.groupBy(kind.alias("k")).agg(F.count("*").alias("x")).collect()), reverse=True), 0, None
    for k, x in classes:
        if over + x > COMMON:
            break
        over, least = over + x, k
    if least is None:
        return np.zeros(0, U64)
    got = words.where(kind >= least).select("n", "w").toArrow().sort_by([("n", "descending"), ("w", "ascending")])
    return got.column("w").to_numpy().view(U64)


def _numbers(df: DataFrame, key: str, value: str, order: np.ndarray) -> np.ndarray:
    """The sums of value by key, for the keys in order: at most SHARES of them."""
    got = {r[0]: r[1] for r in df.groupBy(key).agg(F.sum(value)).collect()}
    return np.array([got.get(int(k), 0) for k in order.view(np.int64)], np.int64)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hold_out: tuple[int, int] = (7, 2), burn_in: int = BURN_IN, samples: int = SAMPLES, strength: float = STRENGTH, part_tokens: int = PART_TOKENS, shares: int = SHARES) -> DataFrame:
    """One row per row of docs: id_col (as long), held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32 of the id in decimal leaves another remainder modulo hold_out[0] than hold_out[1]. A null text is
    empty: its end alone is a token. A null id counts as the empty text, and trains. Rows that share an id are scored apart. Nothing to
    learn from: every probability is that of the base, 1 over the vocabulary and the unknown word. No rows: no result. The parent's probabilities are
    rounded to 1 part in 10**8 where they are moved.
    """
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col, hold_out)
    words = count_words(texts)
    counts = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count_if(F.col("c") > 0).alias("v")).first()
    total, n_train, vocabulary = counts["n"], counts["c"], counts["v"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_tokens))
    least = max(total // (2 * parts), total // shares)
    # at most 2 * parts and at most shares of them
    frequent = {r["w"]: r["c"] for r in words.where(F.col("n") > least).select("w", "c").collect()}
    hot = np.sort(np.array(list(frequent), np.int64).view(U64))
    common = _common(words)
    deal = Deal(parts, hot, np.array([frequent[int(x)] for x in hot.view(np.int64)], np.int64), least, Code(common))
    restaurants = build(texts, deal)
    few = restaurants.where(F.col("kind") == COUNTS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("a"), F.coalesce(F.sum("m"), F.lit(0)).alias("b")).first()
    d = discount(few["a"], few["b"])
    pairs = restaurants.where(F.col("kind") == HOT_PAIR).select("key", "n", "m").collect()  # at most shares of them
    hot_ctx, hot_word, hot_c = (np.array([r[i] for r in pairs], np.int64) for i in (0, 2, 1))
    hot_key = pair_key(hot_ctx.view(U64), hot_word.view(U64))
    order = np.argsort(hot_key)
    hot_ctx, hot_word, hot_c, hot_key = hot_ctx[order].view(U64), hot_word[order].view(U64), hot_c[order], hot_key[order]

    said = restaurants.where(F.col("kind") == DISH)
    guests = materialise(said.groupBy(F.col("key").alias("w")).agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "lm-guests")
    alone = guests.where("n = 1 and m = 0").count()  # words with one customer for good
    guests = guests.where("n + m > 0 and not (n = 1 and m = 0)")
    parent, seated = Parent(guests.select("w", (F.col("n") + F.col("m")).alias("c")), alone, None, 0, vocabulary, strength), None
    steady = guests.where("n > 0").select("w", F.col("n").alias("c"))
    singles = restaurants.where(F.col("kind") == HOT_TABLES)
    # at first each pair has one table
    hot_tables = _numbers(singles, "key", "n", hot) + _hot_kept(restaurants, deal)
    kept = []
    for number in range(1, burn_in + samples + 1):
        got = sweep(restaurants, seated, parent.frame, deal, hot_tables, hot_key, number, d, strength)
        if seated is not None and number - 1 <= burn_in:
            drop_table(seated)
        seated = materialise(got.where(F.col("kind") == SEATING), f"lm-seating-{number}")
        hot_tables = _numbers(got.where(F.col("kind") == HOT_TABLES), "key", "n", hot)
        customers = got.where(F.col("kind") == DISH).select(F.col("key").alias("w"), F.col("n").alias("c")).unionByName(steady)
        before, parent = parent, Parent(customers, alone, parent, number, vocabulary, strength)
        if number > burn_in:
            kept.append((number, seated, parent, hot_tables, _numbers(got.where(F.col("kind") == HOT_PAIR), "key", "n", hot_key)))
        if number - 1 <= burn_in:
            drop_table(before.made)
        drop_table(got)

    model = words.where("c > 0").select("w", "c", *(F.lit(None).cast("double").alias(f"p{i}") for i in range(len(kept))))
    for i, (_, _, p, _, _) in enumerate(kept):
        model = model.unionByName(p.frame.select("w", F.lit(None).cast("long").alias("c"), *((F.col("p") if j == i else F.lit(None).cast("double")).alias(f"p{j}") for j in range(len(kept)))))
    model = materialise(model.groupBy("w").agg(F.max("c").alias("c"), *(F.max(f"p{i}").alias(f"p{i}") for i in range(len(kept)))), "lm-model")
    for x in (words, guests, *(p.made for _, _, p, _, _ in kept)):
        drop_table(x)
    rest = np.array([p.rest for _, _, p, _, _ in kept])
    at_hot = np.stack([x for _, _, _, x, _ in kept])
    single = np.array([p.single for _, _, p, _, _ in kept])
    scorer = Scorer(deal, at_hot, rest, single, d, strength, n_train, vocabulary, [x for x, *_ in kept])
    # the very frequent pairs, at most shares of them
    known = {r["w"]: r for r in model.join(F.broadcast(spark.createDataFrame([(int(x),) for x in np.unique(hot_word.view(np.int64))], "w long")), "w").collect()} if len(hot_key) else {}
    found = [known.get(int(x)) for x in hot_word.view(np.int64)]
    p = np.array([[rest[i] if r is None else single[i] if r[f"p{i}"] is None else r[f"p{i}"] for r in found] for i in range(len(kept))]).reshape(len(kept), -1)
    c_word = np.array([r["c"] if r else 0 for r in found], np.int64)
    at = among(hot, hot_ctx)[0]
    hot_t = np.stack([x for *_, x in kept])
    train = scorer.probability(np.maximum(hot_c, 1), np.where(hot_c > 1, hot_t, 1), at_hot[:, at], deal.customers[at], p) if len(hot_key) else np.zeros(0)
    held = scorer.probability(hot_c, np.where(hot_c > 1, hot_t, np.minimum(hot_c, 1)), at_hot[:, at], deal.customers[at], p) if len(hot_key) else np.zeros(0)
    by_hand = (hot_key, np.log10(train), np.log10(held), scorer.base(c_word), c_word > 0)
    out = _scored(texts, restaurants, [x for _, x, *_ in kept], said, model, deal, scorer, by_hand)
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def _hot_kept(restaurants: DataFrame, deal: Deal) -> np.ndarray:
    """The kept pairs of each very frequent context."""
    if not len(deal.hot):
        return np.zeros(0, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, a in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ctx = deal.code.unpacked(a.as_py(), n)
                at, there = among(deal.hot, ctx)
                yield pa.RecordBatch.from_arrays([pa.array(deal.hot.view(np.int64)), pa.array(np.bincount(at[there], minlength=len(deal.hot)))], names=["key", "n"])

    return _numbers(restaurants.where(F.col("kind") == RESTAURANT).select("key", "a").mapInArrow(count, "key long, n long"), "key", "n", deal.hot)


class Scorer:
    """The predictive probabilities, averaged over the samples."""

    def __init__(self, deal: Deal, hot_tables: np.ndarray, rest: np.ndarray, single: np.ndarray, d: float, strength: float, n_train: int, vocabulary: int, samples: list[int]):
        self.deal, self.hot_tables, self.rest, self.single, self.d, self.strength, self.samples = deal, hot_tables, rest, single, d, strength, samples
        self.n_train, self.vocabulary = n_train, vocabulary

    def probability(self, c: np.ndarray, t: np.ndarray, tables: np.ndarray, customers: np.ndarray, p: np.ndarray) -> np.ndarray:
        """c customers of a dish at t tables (by sample), the restaurant's tables (by sample) and customers, the parent's probability (by sample)."""
        return ((c - self.d * t + (self.strength + self.d * tables) * p) / (self.strength + customers)).mean(0)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n_train + self.vocabulary + 1))


def _scored(texts: DataFrame, restaurants: DataFrame, seatings: list[DataFrame], said: DataFrame, model: DataFrame, deal: Deal, scorer: Scorer, by_hand: tuple) -> DataFrame:
    hot_key, hot_train, hot_held, hot_base, hot_known = by_hand
    n_samples = len(seatings)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, held_all = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, tokens, ctx, text in tokens_of(batch.column(2)):
                held, size = held_all[lo:hi], hi - lo
                pair = pair_key(ctx, tokens)
                at, hot = among(hot_key, pair)
                a, k = at[hot], text[hot]
                score = np.bincount(k, np.where(held[k], hot_held[a], hot_train[a]) if len(a) else None, size).astype(float)
                flat = np.bincount(k, hot_base[a] if len(a) else None, size).astype(float)
                known = np.bincount(k, hot_known[a] if len(a) else None, size).astype(np.int64)
                mine = ids.slice(lo, size)
                count = np.bincount(text, minlength=size).astype(np.int64)
                header = np.stack([count, known, held.astype(np.int64), mine.is_null().to_numpy(zero_copy_only=False).astype(np.int64), mine.fill_null(0).to_numpy()])
                rows = [(HEADER, int(mix(np.full(1, base, U64))[0] % U64(deal.parts)), base, size, 0, packed(header), packed(score), packed(flat), None)]
                for p, i in deal.dealt(ctx, pair, np.flatnonzero(~hot)):
                    first = np.flatnonzero(np.diff(pair[i], prepend=~pair[i[:1]]))
                    j = i[first]
                    many = np.diff(first, append=len(i))
                    body = text[i] * 2 + held[text[i]]
                    rows.append((RESTAURANT, p, base, len(j), len(i), deal.code.packed(ctx[j]), deal.code.packed(tokens[j]), packed_small(many), packed_small(body)))
                yield messages(rows)
                base += size
            give_back()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        x = Part(right, deal.code)
        told = [r for r in right.filter(pc.equal(right.column("kind"), DISH)).to_pylist()]
        words = np.concatenate([unpacked(r["a"], np.int64, r["key"]) for r in told] or [np.zeros(0, np.int64)]).view(U64)
        c_word = np.concatenate([unpacked(r["b"], np.int64, r["key"]) for r in told] or [np.zeros(0, np.int64)])
        wide = -(-n_samples // 2)
        packs = np.concatenate([unpacked(r["c"], np.int64, wide * r["key"]).reshape(wide, -1) for r in told] or [np.zeros((wide, 0), np.int64)], 1)
        order = np.argsort(words)
        words, c_word, packs = words[order], c_word[order], packs[:, order]
        p = np.exp(-LOG_UNIT * np.stack([packs[i // 2] & 0x7FFFFFFF if i % 2 else packs[i // 2] >> 32 for i in range(n_samples)]))
        p = np.where(p == 1, scorer.single[:, None], p)
        t = np.stack([x.t[s] if s in x.t else np.ones(len(x.c), np.int64) for s in scorer.samples])
        total = np.stack([x.all_tables(t[i], deal.hot, scorer.hot_tables[i]) for i in range(n_samples)])
        customers = x.customers.copy()
        at, there = among(deal.hot, x.names)
        customers[there] = deal.customers[at[there]]
        key = pair_key(x.ctx, x.word)
        order = np.argsort(key)
        key, c_pair, t = key[order], x.c[order], t[:, order]
        words, names, key = Known(words), Known(x.names), Known(key)
        out, held_rows, size = [], [], 0
        for i in range(left.num_rows):
            r = {k: left.column(k)[i].as_py() for k in ("kind", "key", "n", "m", "a", "b", "c", "d")}
            if r["kind"] == HEADER:
                out.append((HEADER, 0, r["key"], r["n"], 0, r["a"], r["b"], r["c"], None))
            else:
                held_rows.append(r)
                size += r["n"]
            if held_rows and (size >= TOGETHER or i == left.num_rows - 1):
                out += score_rows(held_rows, names, words, c_word, p, key, c_pair, t, total, customers)
                held_rows, size = [], 0
        if held_rows:
            out += score_rows(held_rows, names, words, c_word, p, key, c_pair, t, total, customers)
        give_back()
        return pa.Table.from_batches([messages(out)])

    def score_rows(rows: list[dict], names: Known, words: Known, c_word, p, key: Known, c_pair, t, total, customers) -> list[tuple]:
        """The sums of some rows' texts, a row each."""
        parts = [(deal.code.unpacked(r["a"], r["n"]), deal.code.unpacked(r["b"], r["n"]), unpacked_small(r["c"], r["n"]), unpacked_small(r["d"], r["m"])) for r in rows]
        ctx, word, many, body = (np.concatenate(v) for v in zip(*parts, strict=True))
        sizes = [int(b.max()) // 2 + 1 for *_, b in parts]  # texts, as far as they occur
        first = np.cumsum([0, *sizes])
        text = body.astype(np.int64) // 2 + np.repeat(first[:-1], [len(b) for *_, b in parts])
        is_held = body % 2 == 1
        at, there = words.among(word)
        pw = np.where(there, p[:, at], scorer.rest[:, None]) if len(c_word) else np.repeat(scorer.rest[:, None], len(word), 1)
        cw = np.where(there, c_word[at], 0) if len(c_word) else np.zeros(len(word), np.int64)
        at, there = names.among(ctx)
        tables = np.where(there, total[:, at], 0) if len(customers) else np.zeros((n_samples, len(ctx)))
        guests = np.where(there, customers[at], 0) if len(customers) else np.zeros(len(ctx))
        at, there = key.among(pair_key(ctx, word))
        c = np.where(there, c_pair[at], 0) if len(c_pair) else np.zeros(len(ctx), np.int64)
        ts = np.where(there, t[:, at], 0) if len(c_pair) else np.zeros((n_samples, len(ctx)), np.int64)
        of = np.repeat(np.arange(len(ctx)), many)
        # a pair of a text in training has a customer; one that is not kept has no other
        train = np.log10(scorer.probability(np.maximum(c, 1), np.maximum(ts, 1), tables, guests, pw)) if not is_held.all() else np.zeros(len(ctx))
        held = np.zeros(len(ctx))
        new = np.flatnonzero(np.bincount(of[is_held], minlength=len(ctx)))
        held[new] = np.log10(scorer.probability(c[new], ts[:, new], tables[:, new], guests[new], pw[:, new]))
        got = np.where(is_held, held[of], train[of])
        n, score = np.bincount(text, minlength=first[-1]), np.bincount(text, got, first[-1])
        flat, seen = np.bincount(text, scorer.base(cw)[of], first[-1]), np.bincount(text, (cw > 0)[of], first[-1])
        out = []
        for r, lo, hi in zip(rows, first[:-1], first[1:], strict=True):
            there = np.flatnonzero(n[lo:hi])
            both = np.round(np.stack([score[lo:hi][there], flat[lo:hi][there]]) / UNIT).astype(np.int64)
            out.append((RESTAURANT, 0, r["key"], len(there), 0, packed(there.astype(np.uint32)), packed(both), packed(seen[lo:hi][there].astype(np.uint32)), None))
        return out

    def total(group: pa.Table) -> pa.Table:
        rows = group.select(["kind", "n", "a", "b", "c"]).to_pylist()
        head = next(r for r in rows if r["kind"] == HEADER)
        size = head["n"]
        count, known, held, null, ids = unpacked(head["a"], np.int64, 5 * size).reshape(5, -1)
        known, score, flat = known.copy(), unpacked(head["b"], float, size).copy(), unpacked(head["c"], float, size).copy()
        for r in sorted((r for r in rows if r["kind"] != HEADER), key=lambda r: r["b"]):  # sums of one order
            at, both = unpacked(r["a"], np.uint32, r["n"]), unpacked(r["b"], np.int64, 2 * r["n"]).reshape(2, -1) * UNIT
            score[at] += both[0]
            flat[at] += both[1]
            known[at] += unpacked(r["c"], np.uint32, r["n"])
        return pa.table({"id": pa.array(ids, mask=null.astype(bool)), "held": pa.array(held.astype(bool)), "n_tokens": count, "n_known": known, "base_score": flat, "score": score})

    pairs = range(-(-n_samples // 2))
    # 0 stands for a word with one customer for good
    log = lambda i: F.when(F.col(f"p{i}").isNull(), 0).otherwise(F.least(F.greatest(F.round(-F.ln(f"p{i}") / LOG_UNIT).cast("long"), F.lit(1)), F.lit((1 << 31) - 1))).cast("long") if i < n_samples else F.lit(0).cast("long")
    short = model.select("w", "c", *(F.shiftleft(log(2 * i), 32).bitwiseOR(log(2 * i + 1)).alias(f"x{i}") for i in pairs))
    answers = said.select("part", F.col("key").alias("w")).join(short.hint("shuffle_hash"), "w").select("part", "w", "c", *(f"x{i}" for i in pairs))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers of one part as one message, for each half a million."""
        held, size = [], 0

        def told() -> pa.RecordBatch:
            cols = [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3 + len(pairs))]
            order = in_order(cols[1].view(U64))[0]
            order = order[placed(cols[0][order].astype(U64) << U64(32))]
            cols = [c[order] for c in cols]
            edges = np.flatnonzero(np.diff(cols[0], prepend=-1, append=-1))
            rows = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                rows.append((DISH, int(cols[0][lo]), hi - lo, 0, 0, packed(cols[1][lo:hi]), packed(cols[2][lo:hi]), packed(np.stack([c[lo:hi] for c in cols[3:]])), None))
            return messages(rows)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 500_000:
                yield told()
                held, size = [], 0
        if size:
            yield told()
        give_back()

    right = restaurants.where(F.col("kind").isin(RESTAURANT, CONTEXTS)).unionByName(answers.mapInArrow(together, _MESSAGE))
    for s in seatings:
        right = right.unionByName(s)
    left = texts.mapInArrow(occurrences, _MESSAGE)
    got = left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(score, _MESSAGE)
    return got.groupBy("key").applyInArrow(total, "id long, held boolean, n_tokens long, n_known long, base_score double, score double")
