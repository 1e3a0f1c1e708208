"""Quality rules as weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0) on a document. Votes are taken as independent given the document's
quality; expectation-maximisation estimates every rule's accuracy and the share of good documents, without labels, and a document's
verdict is its posterior probability of being good. EM needs only how often each pattern of votes occurs: those counts
are taken over all documents, and there are at most 3 ** len(RULES) of them however many documents there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm._store import materialise
from parley.llm._text import IS_SPACE, prefix_hash, runs, sequence_hash, slices, span_hash

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"[#*$%&|<>]"[1:-1])] = True
REPEAT = 8
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_lines", "n_short", "n_lettered", "n_marks")


def _figures(texts: pa.Array) -> np.ndarray:
    out = np.zeros((len(FIGURES), len(texts)), np.int64)
    for lo, hi, data, offs in slices(texts):
        inside = ~IS_SPACE[data]
        start, end, first = runs(inside, offs)
        per = lambda mask, offs=offs: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
        p = prefix_hash(data)
        h = span_hash(p, start, end)
        out[0, lo:hi] = np.diff(first)
        out[1, lo:hi] = per(inside & ((data & 0xC0) != 0x80))
        out[2, lo:hi] = per(SYMBOLS[data])
        upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
        out[5, lo:hi], out[6, lo:hi] = per(upper), per(upper | lower)
        # lines: ends at \n or the text's end; only those with a word count
        breaks = np.flatnonzero(data == 10)
        ls = np.sort(np.concatenate([offs[:-1], breaks + 1]))
        le = np.sort(np.concatenate([offs[1:], breaks]))
        doc = np.searchsorted(offs, ls, "right") - 1
        at_end = ls == offs[-1]
        # an empty text, or one after a last \n, starts a line at the next text's offset; lines without words drop out anyway
        words_before = np.concatenate([[0], np.cumsum(inside)])
        full = (le > ls) & ~at_end
        full[full] = words_before[le[full]] > words_before[ls[full]]
        ls, le, doc = ls[full], le[full], doc[full]
        out[7, lo:hi] = np.bincount(doc, minlength=hi - lo)
        out[3, lo:hi] = np.bincount(doc[_later(span_hash(p, ls, le), doc)], minlength=hi - lo)
        # words in windows of REPEAT words found twice or more in their text
        g = sequence_hash(h, REPEAT)
        at = np.repeat(np.arange(hi - lo), np.diff(first))
        if len(g):
            whole = at[: len(g)] == at[REPEAT - 1 :]
            places = np.flatnonzero(whole)
            twice = places[_twice(g[places], at[places])]
            mark = np.zeros(len(h) + 1, np.int64)
            np.add.at(mark, twice, 1)
            np.add.at(mark, twice + REPEAT, -1)
            out[4, lo:hi] = np.bincount(at[np.cumsum(mark[:-1]) > 0], minlength=hi - lo)
        # short words, as prose of most languages has them; words with a letter; characters of words that are neither letter nor digit
        out[8, lo:hi] = np.bincount(at[(end - start) <= 3], minlength=hi - lo)
        letter = np.concatenate([[0], np.cumsum(upper | lower | (data >= 0xC0))])
        out[9, lo:hi] = np.bincount(at[letter[end] > letter[start]], minlength=hi - lo)
        out[10, lo:hi] = per(inside & (data < 0x80) & ~(upper | lower) & ~((data >= 48) & (data <= 57)))
    return out


def _order(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return order, same


def _later(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places whose value an earlier place of the same text has."""
    order, same = _order(h, doc)
    return order[same]


def _twice(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places whose value another place of the same text has."""
    order, same = _order(h, doc)
    same[:-1] |= same[1:]
    return order[same]


def figures(docs: DataFrame, text_col: str = "text", prefix: str = "", keep: list[str] | None = None) -> DataFrame:
    """docs with the columns of FIGURES (long) added, each under prefix. A null text counts as empty: all are 0.

    keep: the columns of docs to carry along, by default all.
    """
    keep = docs.columns if keep is None else keep
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(prefix + f, T.LongType()) for f in FIGURES])
    docs = docs.select(*dict.fromkeys([*keep, text_col]))
    where, carried = docs.columns.index(text_col), len(keep)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _figures(batch.column(where))
            yield pa.RecordBatch.from_arrays([*batch.columns[:carried], *(pa.array(x) for x in got)], names=[*batch.schema.names[:carried], *(prefix + f for f in FIGURES)])

    return docs.mapInArrow(add, schema)


def rules(prefix: str = "") -> dict[str, Column]:
    """Votes. A rule about a defect votes bad where it finds it and abstains elsewhere: its absence says little. A rule about a
    trait of prose also votes good well within the usual bounds, and abstains between. No evidence, no vote."""
    c = {f: F.col(prefix + f).cast("double") for f in FIGURES}
    words, lines = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["n_lines"], F.lit(1.0))
    some = c["n_words"] >= 20

    def vote(bad: Column, good: Column | None = None) -> Column:
        return F.when(some & bad, -1).when(some & good, 1).otherwise(0) if good is not None else F.when(bad, -1).otherwise(0)

    mean, symbols, repeat, dup = c["word_chars"] / words, c["n_symbols"] / words, c["n_repeat_words"] / words, c["n_dup_lines"] / lines
    upper, short, lettered, marks = c["n_upper"] / F.greatest(c["n_letters"], F.lit(1.0)), c["n_short"] / words, c["n_lettered"] / words, c["n_marks"] / F.greatest(c["word_chars"], F.lit(1.0))
    return {
        "length": vote(c["n_words"] < 20),
        "repeats": vote(repeat > 0.3),
        "lines": vote((dup > 0.3) & (c["n_lines"] >= 4)),
        "case": vote((upper > 0.5) & (c["n_letters"] >= 50)),
        "symbols": vote(symbols > 0.1, symbols < 0.02),
        "lettered": vote(lettered < 0.8, lettered > 0.9),
        "marks": vote(marks > 0.25, marks < 0.1),
        "word_length": vote((mean < 3) | (mean > 10), (mean >= 3.5) & (mean <= 7)),
        "short_words": vote((short < 0.03) | (short > 0.6), (short > 0.1) & (short < 0.5)),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], start: float = 0.8, strength: float = 20.0, rounds: int = 200) -> tuple[float, list[float]]:
    """EM on counts of vote patterns: the share of good documents, and each rule's accuracy where it votes.

    strength: how many imagined votes at accuracy start each rule begins with; it also keeps accuracies off 0 and 1, and
    makes an empty corpus give the start values. Accuracies stay at 0.55 or more: a rule is taken to mean what it says.
    """
    if not patterns:
        return start, []
    v = np.array([p for p, _ in patterns], float)
    n = np.array([c for _, c in patterns], float)
    share, acc = start, np.full(v.shape[1], start)
    for _ in range(rounds):
        post = 1 / (1 + np.exp(-(math.log(share / (1 - share)) + v @ np.log(acc / (1 - acc)))))
        right = (n * post) @ (v > 0) + (n * (1 - post)) @ (v < 0)
        votes = n @ (v != 0)
        new = np.clip((right + strength * start) / (votes + strength), 0.55, 0.99)
        share, old = float(np.clip((n @ post + strength * start) / (n.sum() + strength), 0.05, 0.95)), acc
        acc = new
        if np.abs(acc - old).max() < 1e-9:
            break
    return share, acc.tolist()


def judge(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, prefix: str = "quality_", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns keep, by default all) with figures, prefix + posterior (probability of being good), prefix + base_failed and prefix + kept.

    base_failed: fewer than 20 words, or over 30 % of them in repeated 8-word windows; such a document is never kept. The
    others are kept if the posterior reaches the threshold. Null and empty texts have no words and fail. An empty table gives
    an empty result. Names of docs that clash with an added one raise at once; choose another prefix.
    """
    if clash := {c.lower() for c in docs.columns} & {prefix + x for x in (*FIGURES, "posterior", "base_failed", "kept")}:
        raise ValueError(f"columns {sorted(clash)} are taken; give another prefix")
    seen = materialise(figures(docs, text_col, prefix, keep), "quality-figures")  # taken once: EM reads them, and so does the verdict
    votes = rules(prefix)
    names = [f"v{i}" for i in range(len(votes))]
    counted = seen.select(*(v.alias(n) for n, v in zip(names, votes.values(), strict=True))).groupBy(*names).count().collect()  # at most 3 ** len(votes) rows
    share, acc = fit(sorted((tuple(r)[:-1], r["count"]) for r in counted))
    acc = acc or [0.8] * len(names)
    logit = F.lit(math.log(share / (1 - share)))
    for v, a in zip(votes.values(), acc, strict=True):
        logit = logit + v * F.lit(math.log(a / (1 - a)))
    failed = (F.col(prefix + "n_words") < 20) | (100 * F.col(prefix + "n_repeat_words") > 30 * F.col(prefix + "n_words"))
    return seen.withColumn(prefix + "posterior", 1 / (1 + F.exp(-logit))).withColumn(prefix + "base_failed", failed).withColumn(prefix + "kept", ~failed & (F.col(prefix + "posterior") >= threshold))
