"""Scalar functions on text, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compact(text: Column, most: int = 240) -> Column:
    """White space runs as single spaces, cut to most characters, the last three of them dots."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, max(0, most - 3)), F.lit("..."))).otherwise(t)


def key_part(value: Column) -> Column:
    """Lower case, with whatever is not a-z, 0-9, dot, underscore or hyphen as an underscore."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9._-]", "_")


def idempotency_key(kind: str, meeting: Column, target: Column, utterance: Column | None = None, namespace: str = "meeting") -> Column:
    """namespace:kind:meeting[:utterance]:target; null where a needed part is empty. An empty target is the default one."""
    t = key_part(F.when(F.coalesce(target, F.lit("")) == "", "default").otherwise(target))
    parts = [key_part(meeting), *([key_part(utterance)] if utterance is not None else [])]
    whole = F.concat_ws(":", F.lit(namespace), F.lit(kind), *parts, t)
    ok = parts[0] != ""
    return F.when(ok if len(parts) == 1 else ok & (parts[1] != ""), whole)


def safe_filename(name: Column, most: int = 80) -> Column:
    """Characters that file systems refuse become underscores; '회의록' if nothing is left."""
    t = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r'[\\/:*?"<>|\r\n]+', "_"))
    t = F.substring(F.regexp_replace(t, r"\s+", " "), 1, most)
    return F.when(t == "", "회의록").otherwise(t)


def fingerprint(*parts: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the parts, joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary"), 256), 1, 16)


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def clock(seconds: Column) -> Column:
    """HH:MM:SS; hours take more digits where they need them."""
    s = F.floor(seconds).cast("long")
    h = F.floor(s / 3600).cast("string")
    return F.concat_ws(":", F.when(F.length(h) < 2, F.lpad(h, 2, "0")).otherwise(h), _two(F.floor(s % 3600 / 60)), _two(s % 60))


def minute_clock(seconds: Column) -> Column:
    """mm:ss, with minutes that go on beyond 60."""
    s = F.floor(seconds).cast("long")
    m = F.floor(s / 60).cast("string")
    return F.concat_ws(":", F.when(F.length(m) < 2, F.lpad(m, 2, "0")).otherwise(m), _two(s % 60))


def comment_line(start: Column, speaker: Column, text: Column) -> Column:
    return F.concat(F.lit("["), minute_clock(start), F.lit("] "), speaker, F.lit(": "), text)


def duration(seconds: Column) -> Column:
    """'3초', '2분 3초' or '1시간 2분'."""
    s = F.floor(seconds).cast("long")
    n = lambda c: F.floor(c).cast("long").cast("string")
    short = F.concat(F.bround(seconds, 0).cast("long").cast("string"), F.lit("초"))
    return F.when(seconds < 60, short).when(s < 3600, F.concat(n(s / 60), F.lit("분 "), n(s % 60), F.lit("초"))).otherwise(F.concat(n(s / 3600), F.lit("시간 "), n(s % 3600 / 60), F.lit("분")))


def duration_hms(seconds: Column) -> Column:
    """'1시간 2분 3초', '2분 3초' or '3초', rounded; nothing and negatives are 0."""
    s = F.when(seconds > 0, F.bround(seconds, 0)).otherwise(0).cast("long")
    n = lambda c: F.floor(c).cast("long").cast("string")
    tail = F.concat(n(s % 60), F.lit("초"))
    return F.when(s >= 3600, F.concat(n(s / 3600), F.lit("시간 "), n(s % 3600 / 60), F.lit("분 "), tail)).when(s >= 60, F.concat(n(s / 60), F.lit("분 "), tail)).otherwise(tail)


def html_escaped(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def filename_terms(stem: Column, most: int = 12) -> Column:
    """Words of a file's name that may help a recogniser, in order, each once: no stop words, no long numbers, two characters at least."""
    # Words that say nothing about the content.
    stop = ("직캠", "fancam", "회의", "복사본", "영상", "무대인사", "full", "official")
    bare = F.regexp_replace(stem, r"\([^)]*[A-Za-z0-9_-]{6,}[^)]*\)", " ")
    parts = F.transform(F.split(bare, r"[\s\[\]\(\),/&·|_+\-]+"), lambda t: F.trim(t, F.lit(" .!?:;\"'")))
    good = F.filter(parts, lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(*stop) & ~t.rlike(r"^\d{4,}$"))
    return F.slice(F.array_distinct(good), 1, most)


def recogniser_prompt(base: Column, terms: Column, most: int = 300) -> Column:
    hint = F.when(F.size(terms) > 0, F.concat(F.lit("파일명 힌트: "), F.array_join(terms, ", "), F.lit(".")))
    return F.substring(F.trim(F.concat_ws(" ", hint, F.when(F.coalesce(base, F.lit("")) != "", base))), 1, most)


def inline_markdown(text: Column) -> Column:
    """Escaped text with **bold** and *italic* as tags."""
    t = F.regexp_replace(html_escaped(text), r"\*\*([^*]+)\*\*", "<strong>$1</strong>")
    return F.regexp_replace(t, r"(?<!\*)\*([^*]+)\*(?!\*)", "<em>$1</em>")


def least_summary_chars(duration_s: Column) -> Column:
    """How long the summary of a meeting must be at least, by the meeting's length."""
    return F.when(duration_s >= 5400, 3000).when(duration_s >= 1800, 2000).otherwise(800)


# For each section, the least characters below 15 minutes and below 30 minutes.
SECTION_CHARS = {
    "## 회의 개요": (220, 300),
    "## 회의 흐름 (시간대별)": (220, 350),
    "## 주요 논의 사항": (450, 700),
    "## 발언자별 핵심 메시지": (180, 250),
    "## 결정 사항": (160, 220),
    "## 액션 아이템": (160, 220),
}


def least_section_chars(duration_s: Column, heading: str, default: int) -> Column:
    short, middle = SECTION_CHARS.get(heading, (default, default))
    return F.when(duration_s < 900, min(default, short)).when(duration_s < 1800, min(default, middle)).otherwise(default)


def missing_headings(summary: Column, headings: tuple[str, ...] = tuple(SECTION_CHARS)) -> Column:
    """The headings that a summary lacks."""
    return F.filter(F.array(*(F.lit(h) for h in headings)), lambda h: ~F.contains(F.coalesce(summary, F.lit("")), h))


def chunk_fallback(index: Column, range_: Column, transcript: Column) -> Column:
    """struct<title, summary_md> that keeps a chunk's transcript where no summary of it could be had."""
    body = F.concat(F.lit("## 구간 개요\n- "), range_, F.lit(" 구간은 요약을 얻지 못해 발화 원문을 그대로 둡니다.\n\n## 발화 원문\n"), transcript)
    return F.struct(F.concat(F.lit("구간 "), index.cast("string"), F.lit(" 원문 발화 보존")).alias("title"), body.alias("summary_md"))


_ENDS = r"^\s+|\s+$"


def _stripped(t: Column) -> Column:
    return F.regexp_replace(t, _ENDS, "")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once however often f reads it: it stands in an array of one."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _unfenced(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_stripped(F.coalesce(raw, F.lit(""))), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def json_object(raw: Column) -> Column:
    """The JSON object in a model's reply: an enclosing fence off, from the first brace to the last; empty if there is none."""
    return F.regexp_extract(_unfenced(raw), r"(?s)\{.*\}", 0)


def _cut_off(t: Column) -> Column:
    """What stands after "summary_md" to the reply's end, quotes inside and all, without a closing quote or brace, unescaped."""
    rest = F.regexp_replace(F.regexp_extract(t, r'(?s)"summary_md"\s*:\s*"(.*)', 1), r'\s+$', "")
    rest = F.regexp_replace(rest, r'"\}?$', "")
    for a, b in (("\\n", "\n"), ('\\"', '"'), ("\\\\", "\\")):
        rest = F.replace(rest, F.lit(a), F.lit(b))
    return rest


def _recovered(raw: Column) -> Column:
    """struct<title, summary_md> of a reply: as JSON where that can be read, else its title and what _cut_off makes of it. Null where there is no brace
    or no such text."""

    def read(t: Column) -> Column:
        found = F.regexp_extract(t, r"(?s)\{.*\}", 0)
        return F.from_json(F.nullif(found, F.lit("")), "title string, summary_md string, broken string", {"columnNameOfCorruptRecord": "broken", "allowSingleQuotes": "false"})

    def choose(x: Column) -> Column:
        t, j = x["t"], x["j"]
        part = F.struct(F.regexp_extract(t, r'"title"\s*:\s*"([^"]*)"', 1).alias("title"), _cut_off(t).alias("summary_md"))
        whole = F.struct(j["title"].alias("title"), j["summary_md"].alias("summary_md"))
        return F.when(F.contains(t, F.lit("{")), F.when(j.isNotNull() & j["broken"].isNull(), whole).when(t.rlike(r'"summary_md"\s*:\s*"'), part))

    return once(_unfenced(raw), lambda t: once(F.struct(t.alias("t"), read(t).alias("j")), choose))


def _tidy(got: Column) -> Column:
    name = F.substring(_stripped(F.coalesce(F.nullif(got["title"], F.lit("")), F.lit("회의록"))), 1, 200)
    return once(_stripped(F.coalesce(got["summary_md"], F.lit(""))), lambda body: F.when(body != "", F.struct(name.alias("title"), body.alias("summary_md"))))


def summary_reply(raw: Column) -> Column:
    """struct<title, summary_md> of a reply (_recovered), stripped; '회의록' for a missing title; null where there is no summary."""
    return once(_recovered(raw), _tidy)


def _read_reply(raw: Column, judge: Callable[[Column, Column], Column]) -> Column:
    """judge(what was recovered, the same tidied)."""
    return once(_recovered(raw), lambda got: once(_tidy(got), lambda reply: judge(got, reply)))


def checked_summary(raw: Column, headings: tuple[str, ...] = tuple(SECTION_CHARS), least: Column | int = 2000) -> Column:
    """struct<title, summary_md, problem>: problem is null for a summary that can be used, else unreadable, empty, headings (some are missing) or short."""
    at_least = F.lit(least) if isinstance(least, int) else least

    def judge(got: Column, reply: Column) -> Column:
        lacks = F.size(missing_headings(reply["summary_md"], headings)) > 0 if headings else F.lit(False)
        problem = F.when(got.isNull(), "unreadable").when(reply.isNull(), "empty").when(lacks, "headings").when((at_least > 0) & (F.length(reply["summary_md"]) < at_least), "short")
        return F.struct(reply["title"].alias("title"), reply["summary_md"].alias("summary_md"), problem.alias("problem"))

    return _read_reply(raw, judge)


def section_reply(raw: Column, heading: str, least: Column | int) -> Column:
    """struct<summary_md, problem> of a reply for one section: the heading is put before it where it is missing."""
    at_least = F.lit(least) if isinstance(least, int) else least

    def judge(got: Column, reply: Column) -> Column:
        body = F.when(F.contains(reply["summary_md"], F.lit(heading)), reply["summary_md"]).otherwise(F.concat(F.lit(heading + "\n"), reply["summary_md"]))
        return F.struct(body.alias("summary_md"), F.when(got.isNull(), "unreadable").when(reply.isNull(), "empty").when(F.length(body) < at_least, "short").alias("problem"))

    return _read_reply(raw, judge)


def title_of_reply(raw: Column) -> Column:
    """The title of a reply that can be read as JSON, whatever else it lacks; '회의록' where there is none."""
    j = F.from_json(F.nullif(json_object(raw), F.lit("")), "title string, broken string", {"columnNameOfCorruptRecord": "broken", "allowSingleQuotes": "false"})
    return F.coalesce(F.when(j["broken"].isNull(), F.nullif(F.substring(_stripped(j["title"]), 1, 200), F.lit(""))), F.lit("회의록"))


def title_of_chunks(chunks: DataFrame) -> DataFrame:
    """chunks: meeting_id, chunk, title. Per meeting the first title that says something, '회의록' where none does."""
    t = _stripped(F.coalesce("title", F.lit("")))
    told = F.when((t != "") & ~t.isin("회의록", "구간 요약", "회의 요약"), F.substring(t, 1, 200))
    return chunks.groupBy("meeting_id").agg(F.coalesce(F.min_by(told, F.when(told.isNotNull(), F.col("chunk"))), F.lit("회의록")).alias("title"))
