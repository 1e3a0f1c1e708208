"""Correction rules as data: terms, patterns and replacements."""

from __future__ import annotations

import re
import re._parser as pattern_parser
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.numbering import kept, numbered


def active(rules: DataFrame, scope: str = "global") -> DataFrame:
    """Rules that are enabled and hold for the scope or everywhere."""
    return rules.where(F.col("enabled") & F.col("scope").isin("global", scope))


def rule_list(rules: DataFrame, scope: str = "global", most: int = 10_000) -> list[tuple[str, str]]:
    """(pattern, replacement) in order of id, for replace_all: each is a step of one expression, so more than most are refused here; corrected() takes any number."""
    rows = active(rules, scope).where("pattern is not null and pattern <> ''").orderBy("id").select("pattern", F.coalesce("replacement", "term").alias("r")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules for one expression: take corrected()")
    return [(r["pattern"], r["r"]) for r in rows]


def java_replacement(text: str) -> str:
    """A replacement in Python's notation for Spark: \\1 and \\g<1> become $1, a dollar sign stands for itself."""
    text = text.replace("$", "\\$")
    return re.sub(r"\\g<(\d+)>|\\(\d)", lambda m: "$" + (m[1] or m[2]), text)


def java_pattern(pattern: str) -> str:
    """A pattern in Python's notation for Spark: named groups and references to them."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))


def _runs(pattern: str) -> bool:
    """Does the engine that runs the rules take the pattern?"""
    try:
        SparkSession.getActiveSession()._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def replace_all(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The rules one after another; a pattern that is no regular expression is skipped."""
    for pattern, to in rules:
        if _runs(java_pattern(pattern)):
            text = F.regexp_replace(text, F.lit(java_pattern(pattern)), F.lit(java_replacement(to)))
    return text


def needed_text(pattern: str) -> str:
    """A text that is in whatever the pattern matches, the longest that its top level shows; '' where there is none to be seen."""
    try:
        parsed = pattern_parser.parse(pattern)
    except re.error:
        return ""
    if parsed.state.flags & re.IGNORECASE:
        return ""
    runs = [""]
    for op, arg in parsed:
        if op is pattern_parser.LITERAL:
            runs[-1] += chr(arg)
        elif op is not pattern_parser.AT:  # an anchor stands between letters and takes none
            runs.append("")
    return max(runs, key=len)


class Rules:
    """Rules (pattern, replacement) in their order, as Python's re understands them, and an automaton over the texts they need: one pass over a text tells which can fire."""

    def __init__(self, rules: list[tuple[str, str]]):
        import ahocorasick

        self.rules: list[tuple[re.Pattern, str]] = []
        self.always, need = [], {}
        for pattern, to in rules:
            try:
                found = re.compile(pattern)
            except re.error:
                continue
            text, k = needed_text(pattern), len(self.rules)
            self.rules.append((found, to))
            if text:
                need.setdefault(text, []).append(k)
            else:
                self.always.append(k)
        self.automaton = ahocorasick.Automaton()
        for text, which in need.items():
            self.automaton.add_word(text, which)
        if need:
            self.automaton.make_automaton()
        self.any = bool(need)

    def _able(self, text: str, after: int) -> list[int]:
        found = {k for k in self.always if k > after}
        if self.any:
            for _, which in self.automaton.iter(text):
                found.update(k for k in which if k > after)
        return sorted(found, reverse=True)

    def apply(self, text: str | None) -> str | None:
        """The rules one after another. A rule that changes the text may let later ones fire, so what can fire is looked up anew."""
        if text is None:
            return None
        able = self._able(text, -1)
        while able:
            k = able.pop()
            pattern, to = self.rules[k]
            try:
                new = pattern.sub(to, text)
            except (re.error, IndexError):  # a replacement that names a group the pattern lacks
                continue
            if new != text:
                text, able = new, self._able(new, k)
        return text


#: Lengths of the keys by which rules are looked up: a key is the begin of a needed text, in the greatest of these lengths that it has.
KEY_LENGTHS = (*range(1, 17), 20, 24, 32, 48, 64)
#: Characters that are hashed at once; bits of the filter of keys for each rule, and the power of two that they stay under (16 MB).
SLICE, FILTER_BITS, FILTER_MOST = 1 << 20, 16, 27
#: Rounds of look-ups, after which rows that go on changing are given all rules, block by block; blocks that one job goes through.
ROUNDS, BLOCKS_AT_ONCE = 4, 4
_ODD, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(h: np.ndarray, length: int) -> np.ndarray:
    h = h + np.uint64(length)
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(by)
    return h ^ (h >> np.uint64(33))


class _Keys:
    """Hashes of all stretches of texts that have a key's length, from sums over running powers, so that a stretch's is a difference of two."""

    def __init__(self, lengths: list[int], known: np.ndarray | None = None):
        self.lengths, self.known = lengths, known
        self._powers(1024)

    def _powers(self, n: int) -> None:
        self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_ODD, _BACK))

    def _sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        u = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        if len(u) >= len(self.up):
            self._powers(2 * len(u))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((u + np.uint64(1)) * self.up[: len(u)])]), np.cumsum([0] + [len(t) for t in texts])

    def of_begins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text, none of them empty, its key and the key's length."""
        sums, at = self._sums(texts)
        size, all_lengths = np.diff(at), np.array(KEY_LENGTHS)
        length = all_lengths[np.searchsorted(all_lengths, size, "right") - 1]
        h = (sums[at[:-1] + length] - sums[at[:-1]]) * self.down[at[:-1]]
        out = np.zeros(len(texts), np.uint64)
        for n in np.unique(length):
            out[length == n] = _mixed(h[length == n], int(n))
        return out, length

    def within(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """text (its place in the list), key: all that may be known, each once."""
        sums, at = self._sums(texts)
        row = np.repeat(np.arange(len(texts)), np.diff(at))
        room = at[1:][row] - np.arange(len(row))
        bits = np.uint64(64 - (len(self.known) * 8).bit_length() + 1)
        rows, keys = [], []
        for n in self.lengths:
            if n > len(row):
                break
            h = _mixed((sums[n:] - sums[:-n]) * self.down[: len(row) - n + 1], n)
            slot = (h >> bits).astype(np.int64)
            hit = np.flatnonzero((self.known[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0) & (room[: len(h)] >= n))
            order = hit[np.lexsort((h[hit], row[hit]))]
            r, k = row[order], h[order]
            first = np.ones(len(r), bool)
            first[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
            rows.append(r[first])
            keys.append(k[first])
        return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(keys or [np.zeros(0, np.uint64)])


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def _prepared(wanted: DataFrame) -> DataFrame:
    """wanted (k, pattern, to) without what is no regular expression: k, need (the needed text), pattern (null where the need is all that it matches, and the replacement stands for itself),
    to, key and length (null without a need), chars (those of the needs of some rows, on one of them)."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _Keys([])
        for batch in batches:
            out = []
            for k, pattern, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    re.compile(pattern)
                    parsed = pattern_parser.parse(pattern)
                except re.error:
                    continue
                need, to = needed_text(pattern), to or ""
                whole = need and "\\" not in to and all(op is pattern_parser.LITERAL for op, _ in parsed)
                out.append((k, need, None if whole else pattern, to))
            if not out:
                continue
            key, length = (np.zeros(len(out), x) for x in (np.uint64, np.int64))
            needs = [r[1] for r in out]
            some = np.array([bool(x) for x in needs])
            if some.any():
                key[some], length[some] = keys.of_begins([x for x in needs if x])
            chars = ["".join(sorted(set("".join(needs)))), *[""] * (len(out) - 1)]
            names = ["k", "need", "pattern", "to", "key", "length", "chars"]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)), pa.array(key.view(np.int64), mask=~some), pa.array(length, mask=~some), pa.array(chars)], names=names)

    return wanted.select("k", "pattern", "to").mapInArrow(prepare, "k long, need string, pattern string, to string, key long, length long, chars string")


def _filter(keys: DataFrame, n: int) -> np.ndarray:
    """A bit for each slot of the keys, of which there are at most 2 ** FILTER_MOST; a slot of bits in which many keys meet lets more through."""
    bits = min(FILTER_MOST, max(10, (n * FILTER_BITS).bit_length()))
    slot = F.shiftrightunsigned("key", 64 - bits)
    got = keys.select(F.shiftright(slot, 3).alias("byte"), F.pow(F.lit(2), slot.bitwiseAND(F.lit(7))).cast("int").alias("v")).groupBy("byte").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros((1 << bits) // 8, np.uint8)
    out[got.column("byte").to_numpy()] = got.column("v").to_numpy().astype(np.uint8)
    return out


def _by_key(texts: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts (rid, text) with the rules, prepared, that any text's stretches ask for: rid, text of those that are done; rid, text (as it was) of those that after
    all rounds are not.

    Of each text the keys are looked up by a join, and the rules found are run in their order. Where a change makes a stretch of needed characters that was not there before, its
    keys are looked up too, and the row is run again with all it then has, so that no rule is missed that a change lets fire. All joins shuffle both sides: the planner takes the
    keys for no more than the texts that they are made from, of which there are hundreds for each, and would send them through the driver.
    """
    spark = texts.sparkSession
    chars = frozenset().union(*(r["chars"] for r in rules.where("chars <> ''").select("chars").distinct().collect()))  # characters alone
    told = rules.agg(F.count("key").alias("n"), F.collect_set("length").alias("lengths")).first()
    lengths = sorted(told["lengths"])
    always = [(r["k"], "", r["pattern"], r["to"]) for r in rules.where("key is null").orderBy("k").collect()]
    sent = spark.sparkContext.broadcast((_filter(rules.where("key is not null").select("key"), told["n"]), always, chars))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _Keys(lengths, sent.value[0])
        for batch in batches:
            for at, some in _slices(batch.column(1).to_pylist()):
                row, key = keys.within(some)
                for lo in range(0, len(row), 200_000):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[lo : lo + 200_000] + at)), pa.array(key[lo : lo + 200_000].view(np.int64))], names=["rid", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, always, chars = sent.value
        # a text is cut where no rule needs a character
        apart = re.compile("[^" + "".join(map(re.escape, sorted(chars))) + "]+" if chars else r"(?s:.+)")
        keys, compiled = _Keys(lengths, known), {}

        def one(text: str, able: list) -> tuple[str, list[str]]:
            fresh = set()
            for _, need, pattern, to in sorted({r[0]: r for r in (*able, *always)}.values()):  # a rule that several keys or rounds found runs once
                at = text.find(need)
                if at < 0:
                    continue
                if pattern is None:
                    new = text.replace(need, to)
                    # what differs, up to the characters around it that no rule needs
                    end = len(new) - (len(text) - text.rfind(need) - len(need))
                    while at and new[at - 1] in chars:
                        at -= 1
                    stop = apart.search(new, end)
                    piece = new[at : stop.start() if stop else len(new)]
                else:
                    if pattern not in compiled:
                        if len(compiled) > 20_000:
                            compiled.clear()
                        compiled[pattern] = re.compile(pattern)
                    try:
                        piece = new = compiled[pattern].sub(to, text)
                    except (re.error, IndexError):  # a replacement that names a group the pattern lacks
                        continue
                if new != text:
                    fresh.update(x for x in apart.split(piece) if x not in text)
                    text = new
            return text, sorted(fresh)

        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                texts, asked = batch.column(1).to_pylist(), batch.column(3).to_pylist()
                able = batch.column(2)
                upto = np.cumsum([0, *(n or 0 for n in pc.list_value_length(able).to_pylist())])
                found = list(zip(*(x.to_pylist() for x in able.flatten().flatten()), strict=True))
                got = [one(t, found[a:b]) for t, a, b in zip(texts, upto[:-1], upto[1:], strict=True)]
                more: list[list[int]] = [[] for _ in got]
                owner = [i for i, (_, fresh) in enumerate(got) for _ in fresh]
                for at, some in _slices([x for _, fresh in got for x in fresh]):
                    for row, key in zip(*(x.tolist() for x in (lambda r, k: (r, k.view(np.int64)))(*keys.within(some))), strict=True):
                        more[owner[at + row]].append(key)
                more = [sorted(set(m) - set(a)) for m, a in zip(more, asked, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in got], pa.string()), pa.array(more, pa.list_(pa.int64()))], names=["rid", "text", "new", "more"])

    pairs = texts.mapInArrow(first, "rid long, key long")
    rows = texts.withColumn("asked", F.array().cast("array<long>"))
    rule = F.struct("k", "need", "pattern", "to").alias("rule")
    done, found = None, None
    for _ in range(ROUNDS):
        new = pairs.join(rules.select("key", rule).hint("merge"), "key").select("rid", "rule")
        found = kept(new if found is None else found.join(rows.select("rid").hint("merge"), "rid", "left_semi").unionByName(new))
        able = found.groupBy("rid").agg(F.collect_list("rule").alias("able"))  # as many as a text has stretches that rules ask for
        ran = rows.join(able.hint("merge"), "rid", "left").select("rid", "text", "able", "asked").mapInArrow(run, "rid long, text string, new string, more array<long>")
        ran = kept(ran)
        ended = ran.where(F.size("more") == 0).select("rid", F.col("new").alias("text"))
        done = ended if done is None else done.unionByName(ended)
        going = ran.where(F.size("more") > 0)
        pairs = going.select("rid", F.explode("more").alias("key"))
        rows = going.select("rid", "text", F.col("more").alias("again")).join(rows.select("rid", "asked").hint("merge"), "rid").select("rid", "text", F.concat("asked", "again").alias("asked"))
        if going.isEmpty():
            break
    return done, rows.select("rid", "text")


def _in_blocks(rows: DataFrame, at: int, wanted: DataFrame, n: int, block: int) -> DataFrame:
    """rows with the n rules of wanted (k, pattern, to) applied to the column at the place at: blocks of rules are sent to all tasks and follow one another."""

    def step(rows: DataFrame, sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Rules(sent.value)
            for batch in batches:
                new = pa.array([own.apply(x) for x in batch.column(at).to_pylist()], batch.schema.field(at).type)
                yield batch.set_column(at, batch.schema.field(at), new)

        return rows.mapInArrow(run, rows.schema)

    for k in range(-(-n // block)):
        part = wanted.where((F.col("k") > k * block) & (F.col("k") <= (k + 1) * block)).orderBy("k").select("pattern", "to").collect()  # at most block
        rows = step(rows, rows.sparkSession.sparkContext.broadcast([(r["pattern"], r["to"] or "") for r in part]))
        if (k + 1) % BLOCKS_AT_ONCE == 0 and (k + 1) * block < n:  # each step is a Python process of the task
            rows = kept(rows)
    return rows


def corrected(rows: DataFrame, column: str, rules: DataFrame, scope: str = "global", block: int = 50_000) -> DataFrame:
    """rows with all active rules applied to the text column, in order of id, however many there are. A null text stays null; rules that are no
    regular expressions are skipped.

    Up to block rules are sent to all tasks, where an automaton tells which can fire on a row. Of more, rules are looked up by the texts that they need, so a row meets only
    those that its own text asks for. Rules that need no text meet every row; if these alone are more than block, or if a row goes on changing so that others could fire,
    blocks of all rules follow one another.
    """
    wanted = numbered(active(rules, scope).where("pattern is not null and pattern <> ''").select("id", "pattern", F.coalesce(F.when(F.col("replacement") != "", F.col("replacement")), "term").alias("to")), ["id"], "k")
    n, at = wanted.count(), rows.columns.index(column)
    if n <= block:
        return _in_blocks(rows, at, wanted, n, block)
    wanted = kept(wanted)
    ready = kept(_prepared(wanted))
    if ready.where("key is null").count() > block:
        return _in_blocks(rows, at, wanted, n, block)
    whole = kept(rows.withColumn("__rid", F.monotonically_increasing_id()))
    done, left = _by_key(whole.where(F.col(column).isNotNull()).select(F.col("__rid").alias("rid"), F.col(column).alias("text")), ready)
    if not left.isEmpty():
        done = done.unionByName(_in_blocks(left, 1, wanted, n, block))
    got = whole.join(done.select(F.col("rid").alias("__rid"), F.col("text").alias("__new")).hint("merge"), "__rid", "left")
    return got.select(*(F.col("__new").alias(c) if c == column else F.col(f"`{c}`") for c in rows.columns))


def inline_rules(raw: str) -> list[tuple[str, str]]:
    """'wrong=>right;...' as literal rules; parts without an arrow or a left side are skipped."""
    parts = (p.partition("=>") for p in raw.replace("\n", ";").split(";"))
    return [(a.strip(), b.strip()) for a, arrow, b in parts if arrow and a.strip()]


def replace_literals(text: Column, rules: list[tuple[str, str]]) -> Column:
    for a, b in rules:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def prompt(rules: DataFrame, scope: str = "global", most: int = 224) -> DataFrame:
    """One row: the active terms in order of id as a prompt of most characters at most, empty without terms. Rules are kept by hand, so
    they fit one row."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "term"))), lambda x: x["term"]), ", ")
    said = active(rules, scope).agg(joined.alias("t")).select(F.when(F.col("t") != "", F.concat(F.lit("이 회의에서 등장하는 용어: "), F.col("t"), F.lit("."))).otherwise("").alias("t"))
    return said.select(F.when(F.length("t") > most, F.concat(F.substring("t", 1, most - 1), F.lit("."))).otherwise(F.col("t")).alias("prompt"))


def safe_correction(original: Column, corrected: Column) -> Column:
    """A model's correction, or the original where the correction is empty or so long that it is a rewriting."""
    new = F.regexp_replace(F.coalesce(corrected, F.lit("")), r"^\s+|\s+$", "")
    return F.when((new == "") | (F.length(new) > F.greatest(F.length(original) * 2 + 20, F.lit(40))), original).otherwise(new)


def correction_batches(utterances: DataFrame, size: int = 30) -> DataFrame:
    """utterances (meeting_id, seq, text) in batches for a model: meeting_id, batch, seqs, texts, request (JSON: items of i and text). A batch without any text is not
    sent. seq is dense, so a batch is a division of it, and no meeting is sorted."""
    row = F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))
    by = utterances.groupBy("meeting_id", F.floor(F.col("seq") / size).alias("batch")).agg(F.array_sort(F.collect_list(row)).alias("rows"))  # size at most
    texts = F.transform("rows", lambda r: r["text"])
    items = F.to_json(F.struct(F.transform(texts, lambda x, i: F.struct(i.alias("i"), x.alias("text"))).alias("items")))
    return by.where(F.exists(texts, lambda x: x.rlike(r"\S"))).select("meeting_id", "batch", F.transform("rows", lambda r: r["seq"]).alias("seqs"), texts.alias("texts"), items.alias("request"))


def corrected_items(raw: Column, texts: Column) -> Column:
    """A model's reply to a batch, {"items": [{"i": ..., "text": ...}, ...]}, as the batch's texts: of an i the last item counts, where it is safe (safe_correction);
    items of other numbers, or that are no objects, are passed over. Null where the reply has no such list."""
    from parley.functions.text import json_object, once

    items = F.from_json(F.nullif(json_object(raw), F.lit("")), "items array<string>")["items"]
    told = F.transform(items, lambda x: F.from_json(x, "i string, text string"))

    def put(known: Column) -> Column:
        def one(old: Column, i: Column) -> Column:
            last = F.try_element_at(F.filter(known, lambda x: x["i"].try_cast("double").cast("int") == i), F.lit(-1))
            return once(F.array(F.struct(last.alias("x")))[0], lambda s: F.when(s["x"].isNull(), old).otherwise(safe_correction(old, s["x"]["text"])))

        return F.transform(texts, one)

    return F.when(items.isNotNull(), once(told, put))


def upsert_terms(rules: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """rules with the rows of new (term, pattern, replacement, scope, notes) put in: a rule of the same term, scope and pattern is replaced and enabled
    again and keeps its id; others get ids after the highest. A null scope is the global one, a null pattern an empty one. Of several new rows of one key the last
    by the column order counts, without it the greatest by replacement."""
    scope, pattern = F.coalesce("scope", F.lit("global")), F.coalesce("pattern", F.lit(""))
    what = F.struct(*([F.col(order).alias("o")] if order else []), F.coalesce("replacement", F.lit("")).alias("r"), "replacement", "pattern")
    latest = new.select(F.col("term").alias("n_term"), scope.alias("n_scope"), pattern.alias("n_key"), what.alias("x")).groupBy("n_term", "n_scope", "n_key").agg(F.max("x").alias("x"))
    known = rules.withColumns({"__scope": scope, "__pattern": pattern})
    both = known.join(latest, F.col("term").eqNullSafe(F.col("n_term")) & (F.col("__scope") == F.col("n_scope")) & (F.col("__pattern") == F.col("n_key")), "full_outer")
    hit = F.col("x").isNotNull()
    old = both.where("id is not null").select("id", "term", "pattern", F.when(hit, F.col("x.replacement")).otherwise(F.col("replacement")).alias("replacement"), "scope", F.when(hit, F.lit(True)).otherwise(F.col("enabled")).alias("enabled"))
    added = both.where("id is null").select(F.col("n_term").alias("term"), F.col("x.pattern").alias("pattern"), F.col("x.replacement").alias("replacement"), F.col("n_scope").alias("scope"))
    top = rules.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    added = numbered(added, ["term", "scope", "pattern"], "k").crossJoin(F.broadcast(top))  # one row: the highest id
    return old.unionByName(added.select((F.col("top") + F.col("k")).cast("long").alias("id"), "term", "pattern", "replacement", "scope", F.lit(True).alias("enabled")))
