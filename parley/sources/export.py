"""Sinks of text: HTML pages of meetings, one file for each, and transcripts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from parley.functions.text import clock, comment_line, duration, html_escaped, inline_markdown, safe_filename
from parley.sources.files import filesystem

_HEADING, _ITEM = r"(?U)^(#{1,4})\s+(.*)", r"(?U)^(\s*)[-*]\s+(.*)"
_BLANKS = r"(?U)^\s+|\s+$"


def _bound(value: Column, use) -> Column:
    """use(value), where value is made once however often use reads it."""
    return F.element_at(F.transform(F.array(F.struct(value.alias("v"))), lambda s: use(s["v"])), 1)


def _kind(line: Column) -> Column:
    return F.when(line == "", "b").when(line.rlike(_HEADING), "h").when(line.rlike(_ITEM), "i").otherwise("t")


def markdown_html(text: Column) -> Column:
    """Headings, lists by indent with check boxes, and paragraphs of a summary as HTML, one tag a line.

    A paragraph is what stands between blank lines, headings and items, joined by blanks. A list goes on as long as its
    items follow one another; two blanks of indent are a level.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))

    def joined(ls: Column) -> Column:
        """Blocks: a letter of their kind and their line; those of one paragraph as one line."""
        before = lambda i: F.when(i == 0, "b").otherwise(_kind(F.get(ls, i - 1)))
        parted = F.transform(ls, lambda x, i: F.concat(F.when((_kind(x) == "t") & (before(i) == "t"), " ").otherwise(F.concat(F.when(i == 0, "").otherwise("\n"), _kind(x))), x))
        return F.transform(F.split(F.array_join(parted, ""), "\n"), lambda x: F.struct(F.left(x, F.lit(1)).alias("kind"), F.substring(x, 2, 1 << 30).alias("line")))

    def levels(x: Column) -> Column:
        """Lists open after a block: none, or one more than its indent has levels."""
        return F.when(x["kind"] == "i", F.floor(F.length(F.regexp_extract(x["line"], _ITEM, 1)) / 2) + 1).otherwise(0).cast("int")

    def body(x: Column) -> Column:
        line = x["line"]
        item = F.regexp_replace(F.regexp_extract(line, _ITEM, 2), _BLANKS, "")
        box = r"(?U)^\[([ x])\]\s+(.*)$"
        item = F.when(item.rlike(box), F.concat(F.when(F.regexp_extract(item, box, 1) == "x", "☑ ").otherwise("☐ "), F.regexp_extract(item, box, 2))).otherwise(item)
        level = F.length(F.regexp_extract(line, _HEADING, 1)).cast("string")
        head = F.concat(F.lit("<h"), level, F.lit(">"), inline_markdown(F.regexp_replace(F.regexp_extract(line, _HEADING, 2), _BLANKS, "")), F.lit("</h"), level, F.lit(">"))
        return F.when(x["kind"] == "h", head).when(x["kind"] == "i", F.concat(F.lit("<li>"), inline_markdown(item), F.lit("</li>"))).otherwise(F.concat(F.lit("<p>"), inline_markdown(F.regexp_replace(line, _BLANKS, "")), F.lit("</p>")))

    def block(bs: Column) -> Column:
        old = lambda i: F.when(i == 0, 0).otherwise(levels(F.get(bs, i - 1)))
        tags = lambda now, old: F.concat(F.repeat(F.lit("<ul>\n"), now - old), F.repeat(F.lit("</ul>\n"), old - now))
        # a blank line after the last closes what is open
        return F.transform(F.concat(bs, F.array(F.struct(F.lit("b").alias("kind"), F.lit("").alias("line")))), lambda x, i: F.concat(tags(levels(x), old(i)), F.when(x["kind"] == "b", "").otherwise(F.concat(body(x), F.lit("\n")))))

    html = F.array_join(_bound(_bound(lines, joined), block), "")
    return F.regexp_replace(html, "\n$", "")


def transcripts(utterances: DataFrame) -> DataFrame:
    """Per meeting: lines '[mm:ss] speaker: text' in order."""
    line = comment_line(F.col("start_ms") / 1000, F.coalesce("speaker", F.lit("?")), F.coalesce("text", F.lit("")))
    by = utterances.select("meeting_id", F.struct("seq", line.alias("line")).alias("x")).groupBy("meeting_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return by.select("meeting_id", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("transcript"))


# The labels and class names of a page.
LABELS = ("작성 일시", "원본 파일", "회의 길이", "화자 수")


def html_pages(meetings: DataFrame, utterances: DataFrame, with_transcript: bool = True) -> DataFrame:
    """meeting_id, html. meetings: meeting_id, title, created, source_file, duration_ms, speakers, summary_md. A meeting's page is one row."""
    row = F.concat(F.lit('<tr><td class="ts">'), clock(F.col("start_ms") / 1000), F.lit('</td><td class="speaker">'), html_escaped(F.col("speaker")), F.lit("</td><td>"), html_escaped(F.col("text")), F.lit("</td></tr>"))
    rows = utterances.select("meeting_id", F.struct("seq", row.alias("r")).alias("x")).groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]), "\n").alias("rows"))
    title = html_escaped(F.coalesce("title", F.lit("회의록")))
    meta = [(LABELS[0], html_escaped(F.col("created"))), (LABELS[1], html_escaped(F.regexp_extract(F.coalesce("source_file", F.lit("")), r"[^/\\]*$", 0))), (LABELS[2], duration(F.coalesce("duration_ms", F.lit(0)) / 1000)), (LABELS[3], F.concat(F.coalesce("speakers", F.lit(0)).cast("string"), F.lit("명")))]
    parts = [F.lit('<!doctype html>\n<html lang="ko"><head><meta charset="utf-8"><title>'), title, F.lit("</title></head><body>\n<h1>"), title, F.lit('</h1>\n<div class="meta">')]
    for name, value in meta:
        parts += [F.lit(f"<div><dt>{name}:</dt><dd>"), value, F.lit("</dd></div>")]
    parts += [F.lit("</div>\n"), markdown_html(F.col("summary_md"))]
    if with_transcript:
        table = F.concat(F.lit('\n<div class="transcript"><h2>발화 전문</h2><table><thead><tr><th>시간</th><th>화자</th><th>내용</th></tr></thead><tbody>\n'), F.col("rows"), F.lit("\n</tbody></table></div>"))
        parts.append(F.coalesce(table, F.lit("")))
    return meetings.join(rows, "meeting_id", "left").select("meeting_id", F.concat(*parts, F.lit("\n</body></html>")).alias("html"))


@dataclass
class Pages(WriterCommitMessage):
    """What a task has written: a folder of its own, and how many pages are in it."""

    folder: str
    pages: int


class _PageWriter(DataSourceWriter):
    """Tasks write into folders of their own under one of the job; commit moves the files of those that succeeded into place and drops the rest, so a task that
    runs twice, or a job that fails, leaves no page and no half of one; a task that outlives its failed job may leave its folder, under a name that readers pass over."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, f"_pages-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Pages:
        fs, at = filesystem(self.path)
        folder, n = f"{self.job}/{uuid.uuid4().hex}", 0
        for row in iterator:
            if not n:
                fs.create_dir(f"{at}/{folder}", recursive=True)
            with fs.open_output_stream(f"{at}/{folder}/{row['name']}") as f:
                f.write((row["html"] or "").encode())
            n += 1
        return Pages(folder, n)

    def commit(self, messages: list[Pages | None]) -> None:
        from pyarrow import fs as pafs

        fs, at = filesystem(self.path)
        fs.create_dir(at, recursive=True)
        files = lambda folder: [f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.is_file]
        new = [f for m in messages if m and m.pages for f in files(f"{at}/{m.folder}")]
        if self.overwrite:
            names = {os.path.basename(f) for f in new}
            for f in files(at):
                if f.endswith(".html") and os.path.basename(f) not in names:
                    fs.delete_file(f)
        for f in new:
            fs.move(f, f"{at}/{os.path.basename(f)}")
        self._drop()

    def abort(self, messages: list[Pages | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        from pyarrow import fs as pafs

        fs, at = filesystem(self.path)
        if fs.get_file_info(f"{at}/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{at}/{self.job}")


class MeetingPages(DataSource):
    """A sink of pages: name string, html string; one file for each row."""

    @classmethod
    def name(cls) -> str:
        return "meeting_pages"

    def schema(self) -> str:
        return "name string, html string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _PageWriter(self.options["path"], overwrite)


def page_name(meeting_id: Column, title: Column | None = None) -> Column:
    """The file of a meeting's page: its id and, if given, its title as far as a file's name may hold it."""
    ident = meeting_id.cast("string")
    return F.concat(ident if title is None else F.concat_ws("_", ident, safe_filename(title)), F.lit(".html"))


def write_pages(pages: DataFrame, path: str, overwrite: bool = True) -> None:
    """pages (meeting_id, html, and title if the names are to have it) as files under path, one for each. With overwrite, pages of earlier runs that are not
    among them go. A page is one row; no task holds more than one."""
    spark: SparkSession = pages.sparkSession
    spark.dataSource.register(MeetingPages)
    title = F.col("title") if "title" in pages.columns else None
    rows = pages.select(page_name(F.col("meeting_id"), title).alias("name"), "html")
    rows.write.format("meeting_pages").mode("overwrite" if overwrite else "append").save(path)
