"""Ranked full-text search over an archive, by substring terms as a trigram index would match them, or by whole words.

A term of under three characters matches nothing in trigram mode; matching ignores case and runs over all given columns. The score is BM25 with
k1 = 1.2 and b = 0.75 on trigram (or word) counts, smaller is better.

Advanced queries know "phrases", prefix*, ^first, AND, OR, NOT, parentheses, NEAR(a b, 10) or a NEAR/10 b, and columns (title : a, {title body} : a,
- title : a). Terms side by side bind closest, then NOT, AND, OR. A phrase counts for a row only where the part of the query that it stands in matches.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the ranking and of snippets.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
OPEN, CLOSE, LEFT_OUT = "【", "】", "..."
SNIPPET_TOKENS = 32
NEAR_TOKENS = 10
NEW_PHRASE, SEEN_PHRASE, FIRST_SENTENCE, LATER_SENTENCE = 1000, 1, 120, 100

_LEX = re.compile(r'"((?:[^"]|"")*)"|NEAR/(\d+)|([(){}:,*^-])|([^\s(){}:,"*^-][^\s(){}:,"*^]*)')
_WORD = re.compile(r"[^\W_]+")


class Phrase(NamedTuple):
    text: str
    prefix: bool = False
    first: bool = False


class Near(NamedTuple):
    """Phrases with at most distance tokens between the first and the last of them; one phrase alone is just that phrase."""

    phrases: tuple[Phrase, ...]
    distance: int = NEAR_TOKENS
    columns: tuple[str, ...] | None = None


class Both(NamedTuple):
    """AND, OR or NOT of parts."""

    op: str
    parts: tuple[Near | Both, ...]


def parse(query: str) -> list[str]:
    """The terms of a plain query: white space parts, all of which must match. Quotes are part of a term."""
    return query.split()


def parse_advanced(query: str, columns: list[str] | None = None, mode: str = "trigram") -> Near | Both | None:
    """The tree of an advanced query, None if nothing is asked. ValueError for what is no query or an unknown column."""
    lexed = [("text", m[1].replace('""', '"')) if m[1] is not None else ("near", m[2]) if m[2] else ("sign", m[3]) if m[3] else ("word", m[4]) for m in _LEX.finditer(query)]
    at = 0

    def sees(*wanted: tuple[str, str]) -> bool:
        return lexed[at : at + len(wanted)] == list(wanted)

    def take(*wanted: tuple[str, str]) -> bool:
        nonlocal at
        found = sees(*wanted)
        at += len(wanted) if found else 0
        return found

    def need(sign: str) -> None:
        if not take(("sign", sign)):
            raise ValueError(f"no {sign} where there should be one in the query: {query}")

    def starts() -> bool:
        return at < len(lexed) and (lexed[at][0] == "text" or (lexed[at][0] == "word" and lexed[at][1] not in ("AND", "OR", "NOT")) or lexed[at] in [("sign", s) for s in "({^-"])

    def phrase() -> Phrase:
        nonlocal at
        first = take(("sign", "^"))
        if at >= len(lexed) or lexed[at][0] not in ("text", "word"):
            raise ValueError(f"a term is missing in the query: {query}")
        at += 1
        return Phrase(lexed[at - 1][1], take(("sign", "*")), first)

    def scope(within: tuple[str, ...] | None) -> tuple[str, ...] | None:
        """The columns that a part is limited to, if it says so."""
        nonlocal at
        here = at
        without = take(("sign", "-"))
        names = []
        if take(("sign", "{")):
            while at < len(lexed) and not sees(("sign", "}")):
                names.append(lexed[at][1])
                at += 1
            need("}")
        elif at < len(lexed) and lexed[at][0] in ("text", "word"):
            names.append(lexed[at][1])
            at += 1
        if not names or not take(("sign", ":")):
            at = here
            return within
        if unknown := [n for n in names if n.lower() not in {c.lower() for c in columns or names}]:
            raise ValueError(f"no column {unknown[0]}")
        names = [n.lower() for n in names]
        chosen = [c for c in columns or names if (c.lower() in names) != without]
        return tuple(c for c in chosen if within is None or c in within)

    def primary(within: tuple[str, ...] | None) -> Near | Both | None:
        nonlocal at
        within = scope(within)
        if take(("sign", "(")):
            inner = either(within)
            need(")")
            return inner
        distance = NEAR_TOKENS
        if take(("word", "NEAR"), ("sign", "(")):
            found = [phrase()]
            while not sees(("sign", ",")) and not sees(("sign", ")")):
                found.append(phrase())
            if take(("sign", ",")):
                distance = int(phrase().text)
            need(")")
        else:
            found = [phrase()]
            while at < len(lexed) and lexed[at][0] == "near":
                distance = int(lexed[at][1])
                at += 1
                found.append(phrase())
        # a phrase without tokens says nothing beside others, and alone matches nothing
        return Near(tuple(p for p in found if _size(p, mode)), distance, within)

    def beside(within: tuple[str, ...] | None) -> Near | Both | None:
        parts = [primary(within)]
        while starts():
            parts.append(primary(within))
        told = [p for p in parts if not (isinstance(p, Near) and not p.phrases)] or parts[:1]
        return told[0] if len(told) == 1 else Both("AND", tuple(told))

    def level(op: str, below):  # noqa: ANN001
        def parsed(within: tuple[str, ...] | None) -> Near | Both | None:
            whole = below(within)
            while take(("word", op)):
                whole = Both(op, (whole, below(within)))
            return whole

        return parsed

    either = level("OR", level("AND", level("NOT", beside)))
    if not lexed:
        return None
    tree = either(None)
    if at < len(lexed):
        raise ValueError(f"not understood from {lexed[at][1]} on in the query: {query}")
    return tree


def _size(p: Phrase, mode: str) -> int:
    """Tokens of a phrase."""
    return len(_WORD.findall(p.text)) if mode == "word" else max(len(p.text) - 2, 0)


def _near_parts(tree: Near | Both) -> list[Near]:
    return [tree] if isinstance(tree, Near) else [n for part in tree.parts for n in _near_parts(part)]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _occurrences(text: Column, p: Phrase, mode: str, overlaps: bool = True) -> Column:
    """How often a phrase occurs, overlapping itself included, or from left to right without overlaps."""
    if mode == "word":
        said = [w.lower() for w in _WORD.findall(p.text)]
        if len(said) == 1 and not p.first:
            return F.size(F.filter(_words(text), (lambda w: w.startswith(said[0])) if p.prefix else (lambda w: w == said[0])))
        low, term = F.concat(F.lit(" "), F.array_join(_words(text), " "), F.lit(" ")), " " + " ".join(said) + ("" if p.prefix else " ")
    else:
        low, term = F.lower(text), p.text.lower()
    if p.first:
        return F.startswith(low, F.lit(term)).cast("long")
    if overlaps and any(term.startswith(term[i:]) for i in range(1, len(term))):
        return F.regexp_count(low, F.lit("(?=\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E)"))
    return F.floor((F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / F.lit(len(term)))


def _spans(text: str, mode: str) -> tuple[str, list[tuple[int, int]] | None, int]:
    """The text in lower case, place by place; the spans of its words in word mode; the number of its tokens."""
    low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    words = [m.span() for m in _WORD.finditer(low)] if mode == "word" else None
    return low, words, max(len(low) - 2, 0) if words is None else len(words)


def _places(low: str, words: list[tuple[int, int]] | None, p: Phrase) -> list[int]:
    """Tokens that a phrase begins at."""
    if words is None:
        found = [m.start() for m in re.finditer("(?=" + re.escape(p.text.lower()) + ")", low)]
    else:
        said, every = [w.lower() for w in _WORD.findall(p.text)], [low[a:b] for a, b in words]
        fits = lambda w, s, last: w.startswith(s) if last and p.prefix else w == s
        found = [i for i in range(len(every) - len(said) + 1) if all(fits(every[i + j], s, j == len(said) - 1) for j, s in enumerate(said))]
    return [i for i in found if i == 0] if p.first else found


def _together(places: list[list[int]], sizes: list[int], distance: int) -> list[list[int]]:
    """Of each phrase's places those that stand with a place of every other one: none further before the last one's begin than its size and the distance."""
    kept: list[set[int]] = [set() for _ in places]
    for last in sorted({i for of in places for i in of}):
        cut = [(bisect_left(of, last - size - distance), bisect_right(of, last)) for of, size in zip(places, sizes, strict=True)]
        if all(a < b for a, b in cut):
            for keep, of, (a, b) in zip(kept, places, cut, strict=True):
                keep.update(of[a:b])
    return [sorted(k) for k in kept]


def _found(low: str, words: list[tuple[int, int]] | None, near: Near, mode: str) -> list[list[int]]:
    places = [_places(low, words, p) for p in near.phrases]
    return places if len(places) < 2 else _together(places, [_size(p, mode) for p in near.phrases], near.distance)


def _near_counts(texts: list[Column], near: Near, mode: str) -> Column:
    """Occurrences of each phrase of a NEAR group that count, over the columns; null where all texts are null."""

    @F.pandas_udf("array<long>")
    def counted(t: pd.DataFrame) -> pd.Series:
        def row(*cells: str | None) -> list[int] | None:
            if all(c is None for c in cells):
                return None
            each = [_found(*_spans(c or "", mode)[:2], near, mode) for c in cells]
            return [sum(len(e[i]) for e in each) for i in range(len(near.phrases))]

        return pd.Series([row(*cells) for cells in t.itertuples(index=False)], dtype=object)

    return counted(F.struct(*(t.alias(f"t{i}") for i, t in enumerate(texts))))


def snippet_of(text: str, nears: list[Near], live: list[bool], mode: str = "trigram", tokens: int = SNIPPET_TOKENS) -> str:
    """The window of so many tokens with the most different phrases, then the most hits, best from a sentence's begin; all hits within it are marked."""
    low, words, n = _spans(text, mode)
    begin = lambda i: i if words is None else words[i][0]
    end = lambda i: i + 3 if words is None else words[i][1]
    hits, k = [], 0
    for near, on in zip(nears, live, strict=True):
        for p, of in zip(near.phrases, _found(low, words, near, mode) if on else [[]] * len(near.phrases), strict=True):
            hits += [(i, k, _size(p, mode)) for i in of]
            k += 1
    hits.sort()
    at = [h[0] for h in hits]
    after_stop = {i for m in re.finditer(r"[.:][ \t\n\r]+", low) for i in range(m.start() + 2, m.end() + 1)}
    sentences = [i for i in range(n) if i == 0 or begin(i) in after_stop]

    def score(start: int) -> tuple[int, int]:
        seen, total, within = set(), 0, hits[bisect_left(at, start) : bisect_left(at, start + tokens)]
        for _, k, _ in within:
            total += SEEN_PHRASE if k in seen else NEW_PHRASE
            seen.add(k)
        if not within:
            return 0, start
        last = within[-1][0] + within[-1][2]
        # C's division, towards zero
        return total, max(min(within[0][0] - int((tokens - (last - within[0][0])) / 2), n - tokens), 0)

    best, start = 0, 0
    for i in dict.fromkeys(at):
        got, centred = score(i)
        if got > best:
            best, start = got, centred
        if n > tokens and sentences:
            s = sentences[bisect_right(sentences, i) - 1]
            if s < i:
                got = score(s)[0] + (FIRST_SENTENCE if s == 0 else LATER_SENTENCE)
                if got > best:
                    best, start = got, s
    stop = start + tokens - 1
    whole = stop >= n - 1
    limit = len(text) if whole else end(stop)
    runs: list[list[int]] = []  # hits that share a token are one
    for i, _, size in hits:
        if runs and i <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], i + size - 1)
        else:
            runs.append([i, i + size - 1])
    marks: list[list[int]] = []  # in characters, those that overlap as one
    for a, b in ((begin(i), min(end(j), limit)) for i, j in runs if start <= i <= stop):
        if marks and a < marks[-1][1]:
            marks[-1][1] = max(marks[-1][1], b)
        else:
            marks.append([a, b])
    out, done = [LEFT_OUT] if start else [], begin(start) if start else 0
    for a, b in marks:
        out += [text[done:a], OPEN, text[a:b], CLOSE]
        done = b
    return "".join([*out, text[done:limit], "" if whole else LEFT_OUT])


def _snippets(shown: Column, live: Column, nears: list[Near], mode: str) -> Column:
    @F.pandas_udf("string")
    def cut(texts: pd.Series, on: pd.Series) -> pd.Series:
        return pd.Series([snippet_of(t, nears, [bool(x) for x in o], mode) for t, o in zip(texts, on, strict=True)], dtype=object)

    return cut(shown, live)


def search(rows: DataFrame, query: str, columns: list[str], shown: str, mode: str = "trigram", advanced: bool = False, limit: int | None = 20, where: Column | None = None, snippets: bool = True, overlaps: bool = True) -> DataFrame:
    """The best limit rows (None: all that match): id, score, hits (occurrences of all terms), snippet of the column shown.

    rows: id and columns. where: a filter on the hits; the statistics are those of all rows. No terms: no rows. Of equal scores the lower id
    comes first. Scores of mode word count whole words; a prefix counts words that begin with it. Snippets are cut from the rows returned only.
    Occurrences of a term that overlap each other count, as in SQLite; without overlaps they are taken from left to right, as SQL's replace takes
    them (the terms of a NEAR group count by their places either way).
    """
    if advanced:
        tree = parse_advanced(query, columns, mode)
    else:
        plain = [Near(tuple(p for p in [Phrase(t)] if _size(p, mode))) for t in dict.fromkeys(parse(query))]
        tree = Both("AND", tuple(plain)) if plain else None
    nears = _near_parts(tree) if tree else []
    schema = "id long, score double, hits long" + (", snippet string" if snippets else "")
    if not any(n.phrases for n in nears):
        return rows.sparkSession.createDataFrame([], schema)
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in columns}
    of = lambda near: [texts[c] for c in columns if near.columns is None or c in near.columns]
    total = lambda parts: reduce(lambda a, b: a + b, parts, F.lit(0))
    size = total([F.size(_words(t)) if mode == "word" else F.greatest(F.length(t) - 2, F.lit(0)) for t in texts.values()])
    names = {key: f"tf{i}" for i, key in enumerate(dict.fromkeys((p, n.columns) for n in nears for p in n.phrases))}
    counted = rows.select("*", size.cast("long").alias("d"), *(total([_occurrences(t, p, mode, overlaps) for t in of(Near((p,), columns=cols))]).cast("long").alias(n) for (p, cols), n in names.items()))
    whole = counted.agg(F.count("*").alias("all_rows"), F.sum("d").alias("all_sizes"), *(F.count_if(F.col(n) > 0).alias(f"n_{n}") for n in names.values()))
    groups = {n: f"near{i}" for i, n in enumerate(dict.fromkeys(n for n in nears if len(n.phrases) > 1 and of(n)))}
    for near, name in groups.items():  # only rows that hold every phrase are looked at
        all_there = reduce(lambda a, b: a & b, [F.col(names[p, near.columns]) > 0 for p in near.phrases])
        counted = counted.withColumn(name, _near_counts([F.when(all_there, t) for t in of(near)], near, mode))
    c = counted.crossJoin(F.broadcast(whole))  # one row of totals

    def matches(node: Near | Both) -> Column:
        if isinstance(node, Near):
            if not node.phrases or not of(node):
                return F.lit(False)
            return F.coalesce(F.col(groups[node])[0] > 0, F.lit(False)) if node in groups else F.col(names[node.phrases[0], node.columns]) > 0
        if node.op == "NOT":
            return matches(node.parts[0]) & ~matches(node.parts[1])
        return reduce((lambda a, b: a & b) if node.op == "AND" else (lambda a, b: a | b), [matches(p) for p in node.parts])

    def counts(node: Near | Both, live: Column) -> list[tuple[Near, Phrase, Column, Column]]:
        """Each phrase's count where the parts that it stands in match, in order."""
        if isinstance(node, Near):
            seen = [F.coalesce(F.col(groups[node])[i], F.lit(0)) if node in groups else F.col(names[p, node.columns]) for i, p in enumerate(node.phrases)]
            return [(node, p, F.when(live, n).otherwise(0).cast("long"), live) for p, n in zip(node.phrases, seen, strict=True)]
        within = [live & matches(p) if node.op == "OR" else live for p in node.parts]
        if node.op == "NOT":
            within[1] = F.lit(False)
        return [x for p, on in zip(node.parts, within, strict=True) for x in counts(p, on)]

    hits = c.where(matches(tree) if where is None else matches(tree) & where)
    found = counts(tree, F.lit(True))
    hits = hits.select("*", *(n.alias(f"f{i}") for i, (_, _, n, _) in enumerate(found)))
    score = F.lit(0.0)
    for i, (near, p, _, _) in enumerate(found):
        n, f = F.col(f"n_{names[p, near.columns]}"), F.col(f"f{i}")
        idf = F.ln((F.col("all_rows") - n + 0.5) / (n + 0.5))
        idf = F.when(idf > 0, idf).otherwise(LEAST_IDF)
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("d") * F.col("all_rows") / F.greatest(F.col("all_sizes"), F.lit(1))))
    out = [F.col("id"), (-score).alias("score"), total([F.col(f"f{i}") for i in range(len(found))]).cast("long").alias("hits")]
    if not snippets:
        best = hits.select(*out).orderBy("score", "id")
        return best if limit is None else best.limit(limit)
    heads = [sum(len(n.phrases) for n in nears[:i]) for i in range(len(nears))]
    live = F.array(*(F.col(f"f{h}") > 0 if n.phrases and (n.columns is None or shown in n.columns) else F.lit(False) for n, h in zip(nears, heads, strict=True)))
    best = hits.select(*out, F.coalesce(F.col(shown), F.lit("")).alias("shown"), live.alias("live")).orderBy("score", "id")
    best = best if limit is None else best.limit(limit)
    return best.select("id", "score", "hits", _snippets(F.col("shown"), F.col("live"), nears, mode).alias("snippet"))


def trigram_postings(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The index behind candidate search at scale: gram, id; each gram of a row once. Partition or bucket it by gram when it is stored."""
    # a look-ahead matches at every place, so the text is gone through once
    grams = lambda c: F.regexp_extract_all(F.lower(c), F.lit("(?s)(?=(.{3}))"), F.lit(1))
    every = F.array_distinct(F.concat(*(grams(F.coalesce(F.col(c), F.lit(""))) for c in columns)))
    return rows.select("id", F.explode(every).alias("gram")).where(F.length("gram") == 3)


def candidates(postings: DataFrame, term: str) -> DataFrame:
    """Ids whose rows hold every gram of term (a superset of the rows that hold term)."""
    grams = sorted({term.lower()[i : i + 3] for i in range(len(term) - 2)})
    return postings.where(F.col("gram").isin(grams)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")


def candidates_in(rows: DataFrame, columns: list[str], term: str) -> DataFrame:
    """The same for one search without a stored index: each row is asked for the term's grams, and no posting is made."""
    grams = sorted({term.lower()[i : i + 3] for i in range(len(term) - 2)})
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    holds = lambda g: reduce(lambda a, b: a | b, [F.contains(t, F.lit(g)) for t in low])
    return rows.where(reduce(lambda a, b: a & b, [holds(g) for g in grams], F.lit(bool(grams)))).select("id")
