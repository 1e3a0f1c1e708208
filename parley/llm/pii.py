"""Personal data and secrets in text. DataFrame functions only.

Regular expressions propose spans, validators check them (Luhn for cards, mod 97 for IBANs, length and variety of characters for secrets), and
the words around a span adjust its score: it starts at the kind's base score, a passed check adds CONFIRMED where the kind has a checksum, a word
that speaks for it, in the CONTEXT_CHARS before or after it, adds CONTEXT, one before it that speaks against it (an example, an order number) takes CONTEXT off, and it
stays if it reaches THRESHOLD. Other matches of the kind may stand between a span and its words.

The four base kinds (email, ip, card, phone) follow fixed patterns and always stay. In the expressions below repetitions are possessive and
each starts only where a run of its characters starts (or where the last match ended), which finds the same matches in
time linear in the text: the characters that follow a run decide alike for each start within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "A-Za-z0-9._%+-"
BASE_PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole chains of digits with single separators that have 16 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![0-9])(?![\x20-][0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Without one of these in a text, the kind has no match.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
_NUMBERS = ("order", "invoice", "serial", "part no", "article", "isbn", "version")
_MADE_UP = ("example", "sample", "dummy", "placeholder")
#: Kinds beyond the base: pattern, base score, whether a checksum confirms it, and the words (lower case) in the CONTEXT_CHARS before it that speak for it and
#: against it. A key stands out by its issuer's prefix and its length, a secret is any long run of letters and digits.
EXTRA = {
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", 0.3, True, ("iban", "account", "konto", "compte", "cuenta"), _MADE_UP),
    "short_card": (r"(?<![0-9])(?<![0-9][\x20.-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![0-9])(?![\x20.-][0-9])", 0.1, True, ("card", "visa", "amex", "karte", "carte", "tarjeta"), (*_MADE_UP, *_NUMBERS)),
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, False, ("ssn", "social security", "tax id", "national id"), (*_MADE_UP, *_NUMBERS)),
    "local_phone": (r"(?<![0-9+().-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9]|[.-][0-9])", 0.3, False, ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"), (*_MADE_UP, *_NUMBERS)),
    "key": (r"(?<![A-Za-z0-9_-])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{20,}+|sk-[A-Za-z0-9_-]{32,}+|eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)(?![A-Za-z0-9_-])|-----BEGIN [A-Z ]*PRIVATE KEY-----", 0.8, False, (), _MADE_UP),
    "secret": (r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+", 0.3, False, ("token", "secret", "password", "passwd", "api key", "api_key", "apikey", "access key", "access_key", "bearer", "credential"), (*_MADE_UP, "commit", "checksum", "sha1", "sha256", "md5", "digest")),
}
CONTEXT, CONFIRMED, THRESHOLD, CONTEXT_CHARS = 0.3, 0.3, 0.5, 40
#: Different characters that a secret has at least.
VARIETY = 10
_PART = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(d == "", 0).otherwise((d.cast("int") * (1 + i % 2)) - F.when((i % 2 == 1) & (d.cast("int") > 4), 9).otherwise(0))), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's check digits are right."""
    bare = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    step = lambda a, c: F.when(c == "", a).when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: p.rlike(_PART))
    if kind in ("card", "short_card"):
        return luhn(_digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    if kind == "iban":
        return mod97(x) & F.length(F.regexp_replace(x, " ", "")).between(15, 34)
    if kind == "secret":
        return x.rlike("[0-9]") & x.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(x, ""))) >= VARIETY)
    return F.lit(True)


#: Entries of an array that are summed up in one go.
RUN = 64


def _bound(value: Column, use) -> Column:
    """use(value), where value is made once: it stands in an array of one."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sums_before(sizes: Column) -> Column:
    """For each entry the sum of those before it. Arrays grow by copying, so short runs are summed first, then the entries of each run: of n entries
    about n * RUN / 2 + (n / RUN)**2 / 2 copies."""
    none = F.array().cast("array<int>")
    run = lambda x, k: F.slice(x, k * RUN + 1, F.lit(RUN))
    grow = lambda xs, at: F.aggregate(xs, F.struct(at.alias("at"), none.alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    runs = lambda x: F.sequence(F.lit(0), F.greatest(F.floor((F.size(x) - 1) / RUN).cast("int"), F.lit(0)))

    def summed(x: Column) -> Column:
        totals = F.transform(runs(x), lambda k: F.aggregate(run(x, k), F.lit(0), lambda a, n: a + n))
        return _bound(F.struct(grow(totals, F.lit(0)).alias("at")), lambda s: F.flatten(F.transform(runs(x), lambda k: grow(run(x, k), F.get(s["at"], k)))))

    return _bound(F.struct(sizes.alias("x")), lambda s: summed(s["x"]))


def _right(x: Column) -> Column:
    return F.when(F.length(x) > CONTEXT_CHARS, F.right(x, F.lit(CONTEXT_CHARS))).otherwise(x)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found, before, after>> of all matches, in code points; before, after: up to CONTEXT_CHARS characters, lower-cased, over up to two
    other matches."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(p: Column) -> Column:
        """p: gaps (one more than found), found, at: what stands before each match."""
        part = lambda name, i: F.coalesce(F.get(p[name], i), F.lit(""))

        def item(x: Column, i: Column) -> Column:
            before = F.concat(_right(part("gaps", i - 2)), part("found", i - 2), _right(part("gaps", i - 1)), part("found", i - 1), _right(part("gaps", i)))
            head = lambda g: F.left(g, F.lit(CONTEXT_CHARS))
            after = F.concat(head(part("gaps", i + 1)), F.when(F.length(part("gaps", i + 1)) < CONTEXT_CHARS, F.concat(part("found", i + 1), head(part("gaps", i + 2)))).otherwise(""))
            start = F.get(p["at"], i) + F.length(part("gaps", i))
            return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("found"), F.lower(_right(before)).alias("before"), F.lower(head(after)).alias("after"))

        return F.transform(p["found"], item)

    sizes = lambda p: F.transform(p["gaps"], lambda g, i: F.length(g) + F.coalesce(F.length(F.get(p["found"], i)), F.lit(0)))
    return _bound(F.struct(gaps.alias("gaps"), found.alias("found")), lambda p: _bound(F.struct(p["gaps"].alias("gaps"), p["found"].alias("found"), _sums_before(sizes(p)).alias("at")), placed))


SPAN = "array<struct<kind:string,start:int,end:int,found:string,score:double>>"


def _said(before: Column, words: tuple[str, ...]) -> Column:
    return before.rlike(r"(?<![a-z])(?:" + "|".join(words) + ")") if words else F.lit(False)


def _kind(text: Column, kind: str, pattern: str, needs: str) -> Column:
    def score(x: Column) -> Column:
        if kind not in EXTRA:
            return F.lit(1.0)
        _, base, checked, pro, con = EXTRA[kind]
        moved = F.when(_said(x["before"], pro) | _said(x["after"], pro), CONTEXT).otherwise(0.0) - F.when(_said(x["before"], con), CONTEXT).otherwise(0.0)
        return F.round(F.lit(base + (CONFIRMED if checked else 0.0)) + moved, 2)

    scored = F.transform(_matches(text, pattern), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"), score(x).alias("score")))
    return F.when(text.rlike(needs), F.filter(scored, lambda x: (x["score"] >= THRESHOLD) & _valid(kind, x["found"]))).otherwise(F.array().cast(SPAN))


def _overlapping(spans: Column, e: Column) -> Column:
    """Those of spans, which are sorted and do not overlap each other, that overlap e; found by halving."""

    def least(holds) -> Column:
        """The first place from which on holds(span) is true, or their number."""
        size = F.size(spans)

        def halve(a: Column, _: Column) -> Column:
            middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
            return F.when(a["lo"] >= a["hi"], a).otherwise(F.when(holds(F.get(spans, middle)), F.struct(a["lo"].alias("lo"), middle.alias("hi"))).otherwise(F.struct((middle + 1).alias("lo"), a["hi"].alias("hi"))))

        return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(size + 1)).cast("int") + 1), F.struct(F.lit(0).alias("lo"), size.alias("hi")), halve, lambda a: a["lo"])

    cut = F.slice(spans, least(lambda s: s["end"] > e["start"]) + 1, F.greatest(least(lambda s: s["start"] >= e["end"]) - least(lambda s: s["end"] > e["start"]), F.lit(0)))
    return F.when(F.size(spans) == 0, F.array().cast(SPAN)).otherwise(cut)


def find(docs: DataFrame, text_col: str = "text", into: str = "pii") -> DataFrame:
    """docs with a column into: array<struct<kind, start, end, found, score>> in order of kind (base kinds, then EXTRA), then start.

    Starts and ends are code points, ends exclusive. A null or empty text has none; ids play no part. Spans of an extra kind that overlap one of a
    base kind are left out, and of two extra ones that overlap the one with the lower score (of equal scores the later kind); spans of different base kinds
    may overlap. Copies are found in each row anew.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = {**{k: (p, NEEDS[k]) for k, p in BASE_PATTERNS.items()}, **{k: (v[0], v[0]) for k, v in EXTRA.items()}}
    place = {k: i for i, k in enumerate(EXTRA)}

    def stronger(k: str, kind: str, e: Column):
        earlier = F.lit(place[k] < place[kind])
        return lambda o: (o["score"] > e["score"]) | ((o["score"] == e["score"]) & earlier)

    def kept(x: Column) -> Column:
        def free(kind: str, e: Column) -> Column:
            """No base span, and no stronger extra one, overlaps e."""
            ok = F.lit(True)
            for k in kinds:
                if k in BASE_PATTERNS:
                    ok = ok & (F.size(_overlapping(x[k], e)) == 0)
                elif k != kind:
                    ok = ok & ~F.exists(_overlapping(x[k], e), stronger(k, kind, e))
            return ok

        alone = lambda k: F.when(F.size(x[k]) > 0, F.filter(x[k], lambda e: free(k, e))).otherwise(x[k])
        extra = [alone(k) for k in EXTRA]
        return F.concat(*(x[k] for k in BASE_PATTERNS), *extra)

    both = _bound(F.struct(*(_kind(text, k, *of).alias(k) for k, of in kinds.items())), kept)
    # only texts with a digit, an @ or what keys begin with are looked at further
    return docs.withColumn(into, F.when(text.rlike("[0-9@]|-----BEGIN |AKIA|gh[pousr]_|xox|sk-|eyJ"), both).otherwise(F.array().cast(SPAN)))


def mask(docs: DataFrame, text_col: str = "text", into: str = "masked") -> DataFrame:
    """docs with a column into: the text with each span replaced by its kind in square brackets (of overlapping spans, the first)."""
    own = "__pii"
    while own in docs.columns:
        own += "_"
    found = find(docs, text_col, own)
    order = F.array_sort(F.transform(own, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.element_at(F.transform(F.array(F.struct(text.alias("t"), order.alias("o"))), lambda x: F.aggregate(x["o"], start, lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(x["t"], a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"))), lambda a: F.concat(a["out"], F.substring(x["t"], a["at"] + 1, F.length(x["t"]))))), 1)
    return found.withColumn(into, F.when(F.col(text_col).isNotNull(), whole)).drop(own)


def span_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """find() in figures: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, comma-joined), n_secret (secrets and keys) and n_spans (of all
    kinds). One row per row of docs: ids may be null or repeated, and an empty table gives none."""
    got = find(docs.select(id_col, text_col), text_col, "pii").drop(text_col)
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE_PATTERNS))
    return got.select(id_col, *(count(k).alias(f"n_{k}") for k in BASE_PATTERNS), F.sha2(F.array_join(F.transform(base, said), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("pii", said), ",").alias("spans"), (count("secret") + count("key")).alias("n_secret"), F.size("pii").cast("long").alias("n_spans"))
