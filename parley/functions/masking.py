"""Masking of Korean personal data, as Column expressions: cards, resident numbers, mobile and other phones, accounts, e-mail addresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import once

# The patterns, in the order in which they are applied, and the labels.
PATTERNS = {
    "card": r"(?<!\d)(\d{4})[-.\s]?(\d{4})[-.\s]?(\d{4})[-.\s]?(\d{4})(?!\d)",
    "rrn": r"(?<!\d)(\d{6})[-]?([1-4]\d{6})(?!\d)",
    "mobile": r"(?<!\d)(01[016-9])[-.\s]?(\d{3,4})[-.\s]?(\d{4})(?!\d)",
    "phone": r"(?<!\d)(?:0[2-6][0-9]?[-.\s]?\d{3,4}[-.\s]?\d{4}|1[5-9]\d{2}[-.\s]?\d{4})(?!\d)",
    "account": r"(?<!\d)(\d{3,6})[-](\d{2,4})[-](\d{4,7})(?!\d)",
    "email": r"\b([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Za-z]{2,})\b",
}
#: The same for Java, where digits, spaces and word boundaries are those of Unicode only on demand.
UNICODE = {k: f"(?U){p}" for k, p in PATTERNS.items()}
#: What every match holds; other texts stay as they are.
NEEDS = r"(?U)\d{4}|@"
LABELS = {"card": "[카드번호]", "rrn": "[주민번호]", "mobile": "[휴대폰]", "phone": "[전화번호]", "account": "[계좌번호]", "email": "[이메일]"}


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n)


def _partial(kind: str, m: Column) -> Column:
    """What a match becomes. Patterns are anchored here, as the match stands alone."""
    g = lambda i: F.regexp_extract(m, UNICODE[kind], i)
    if kind == "mobile":
        return F.concat(g(1), F.lit("-"), _stars(F.length(g(2))), F.lit("-**"), F.substring(g(3), 3, 2))
    if kind == "phone":
        n = F.length(m)
        return F.concat(F.regexp_replace(F.substring(m, F.lit(1), n - 4), r"(?U)\d", "*"), F.substring(m, n - 3, F.lit(4)))
    if kind == "account":
        return F.concat(g(1), F.lit("-"), _stars(F.length(g(2))), F.lit("-"), F.substring(g(3), 1, 2), _stars(F.length(g(3)) - 2))
    local = g(1)
    n = F.length(local)
    masked = F.when(n <= 2, _stars(n)).otherwise(F.concat(F.substring(local, 1, 1), _stars(n - 2), F.substring(local, n, F.lit(1))))
    return F.concat(masked, F.lit("@"), g(2))


def _each(text: Column, kind: str) -> Column:
    """text with each match replaced: the pieces between matches, and what the matches become, put together in turn."""
    p = UNICODE[kind]
    pieces = F.arrays_zip(F.split(text, p, -1).alias("gap"), F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: _partial(kind, m)).alias("to"))
    return F.array_join(F.transform(pieces, lambda x: F.concat(x["gap"], F.coalesce(x["to"], F.lit("")))), "")


def _step(kind: str) -> Callable[[Column], Column]:
    return lambda t: F.when(t.rlike(UNICODE[kind]), _each(t, kind)).otherwise(t)


def mask(text: Column, level: str = "full") -> Column:
    """level full: labels; partial: some characters stay; anything else: the text as it is. A partly masked resident number keeps two last digits."""
    if level not in ("full", "partial"):
        return text
    whole = text
    for kind, p in UNICODE.items():
        if level == "full":
            text = F.regexp_replace(text, p, LABELS[kind])
        elif kind == "card":
            text = F.regexp_replace(text, p, "$1-****-****-$4")
        elif kind == "rrn":
            text = F.regexp_replace(text, r"(?U)(?<!\d)(\d{6})[-]?([1-4])\d{4}(\d{2})(?!\d)", "$1-$2****$3")
        else:  # within an array of one, so that what came before is worked out once
            text = once(text, _step(kind))
    return F.when(whole.rlike(NEEDS), text).otherwise(whole)


def mask_rows(rows: DataFrame, level: str = "full", column: str = "text") -> DataFrame:
    """rows with column masked, and changed: whether that made a difference."""
    both = rows.withColumn("__masked", mask(F.col(column), level))
    return both.withColumn("changed", ~F.col(column).eqNullSafe(F.col("__masked"))).withColumn(column, F.col("__masked")).drop("__masked")
