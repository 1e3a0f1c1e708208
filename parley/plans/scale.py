"""Queries on stored postings, any number of rules, many references and summaries in blocks; with the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import dictionary, text
from parley.operators import intervals, postings, sequence, vectors
from parley.operators.numbering import kept, numbered
from parley.plans import talk
from parley.plans.archive import M
from parley.sources import export
from parley.sources import tables as t

PHRASE = "Apache License"


def posting_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The posting table of all documents, in two batches, and a phrase looked up in it."""
    rows = t.documents_as_meetings(spark, d)
    table = f"parley_postings_{uuid.uuid4().hex}"
    try:
        for part in (F.col("id") % 2 == 0, F.col("id") % 2 == 1):
            postings.add(rows.where(part), ["title", "body"], table)
        return kept(postings.phrase_hits(spark, table, PHRASE))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _word_rules(spark: SparkSession, d: str) -> DataFrame:
    """A rule for each different word of six letters or more in all conversations: its first three letters and a tilde."""
    words = t.read(spark, d, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("pattern")).distinct()
    rules = numbered(words, ["pattern"], "id")
    return rules.select("id", F.col("pattern").alias("term"), "pattern", F.concat(F.left("pattern", F.lit(3)), F.lit("~")).alias("replacement"), F.lit("global").alias("scope"), F.lit(True).alias("enabled"))


def rules_all(spark: SparkSession, d: str) -> DataFrame:
    c = t.read(spark, d, "conversations").select("conv_id", "turn", "text")
    return dictionary.corrected(c, "text", _word_rules(spark, d), block=2_000).select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("digest"))


def nearest_reference(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's nearest of the centroids of all labels by the last digit of the vector's number, in several blocks."""
    e = t.read(spark, d, "embeddings").withColumn("digit", F.col("vec_id") % 10)
    refs = vectors.centroids(e, ["label", "digit"]).select((F.col("label") * 10 + F.col("digit")).alias("ref"), "centroid")
    return vectors.match(e.select("vec_id", "embedding"), refs, 0.2, block_numbers=2_000).select("vec_id", "ref", F.round("similarity", 5).alias("similarity"))


def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lists in lists, check boxes, and paragraphs of several lines."""
    n = F.col("p_name")
    md = F.concat(F.lit("## "), n, F.lit("\n- [x] "), n, F.lit("\n  - **"), F.col("p_brand"), F.lit("**\n    * deep\n- [ ] open\n\n one *"), F.col("p_type"), F.lit("*\ntwo & three\n# end"))
    return t.read(spark, d, "part").select("p_partkey", export.markdown_html(md).alias("html"))


def overlap_sweep(spark: SparkSession, d: str) -> DataFrame:
    s, turns = talk.segments_and_turns(spark, d)
    return intervals.assign_by_sweep(s, turns, 16).select("meeting_id", "seq", "assigned", "overlap_ms")


def chunk_jumps(spark: SparkSession, d: str) -> DataFrame:
    return sequence.chunk_by_jumps(t.spoken_utterances(spark, d), 30_000)


def context_fit(spark: SparkSession, d: str) -> DataFrame:
    """Each document, forty times over, as a transcript."""
    fit = sequence.context_fit(F.repeat(F.col("text"), F.lit(40)), 65_536)
    return t.read(spark, d, "documents").select("doc_id", fit["tokens"].alias("tokens"), fit["fits"].alias("fits"), fit["recommended"].alias("recommended"))


def correction_replies(spark: SparkSession, d: str) -> DataFrame:
    """Batches of all conversations, and replies to them that reverse short texts, rewrite long ones, and are unreadable for some."""
    c = t.read(spark, d, "conversations").select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("seq"), "text")
    b = dictionary.correction_batches(c, 3)
    item = lambda x, i: F.to_json(F.struct(i.alias("i"), F.when(F.length(x) < 200, F.reverse(x)).otherwise(F.repeat(x, F.lit(3))).alias("text")))
    reply = F.when(F.col("meeting_id") % 5 == 0, F.lit("no list here {}")).otherwise(F.concat(F.lit('```json\n{"items": [7, {"i": 99, "text": "x"}, '), F.array_join(F.transform("texts", item), ", "), F.lit("]}\n```")))
    got = b.select("meeting_id", F.explode(F.arrays_zip("seqs", F.coalesce(dictionary.corrected_items(reply, F.col("texts")), F.col("texts")).alias("new"))).alias("z"))
    return got.select("meeting_id", F.col("z.seqs").alias("seq"), F.md5(F.col("z.new").cast("binary")).alias("digest"))


def reply_titles(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey") % 4
    raw = F.when(n == 0, F.concat(F.lit('{"title": "  '), "p_name", F.lit(' ", "x": 1}'))).when(n == 1, F.lit("broken reply")).when(n == 2, F.lit('{"title": "", "summary_md": "x"}')).otherwise(F.concat(F.lit('{"title": "'), "p_name"))
    return t.read(spark, d, "part").select("p_partkey", text.title_of_reply(raw).alias("title"))


QUERIES = {f.__name__: f for f in (overlap_sweep, chunk_jumps, context_fit, correction_replies, reply_titles, posting_phrases, rules_all, nearest_reference, markdown_blocks)}

_NL = "chr(10)"
ORACLE_SQL = {
    "overlap_sweep": talk.ORACLE_SQL["overlap_assign"],
    "chunk_jumps": talk.ORACLE_SQL["chunk_utterances"],
    "context_fit": "SELECT doc_id, t AS tokens, t <= 65536 AS fits, least(131072, greatest(4096, (t // 1024 + 1) * 1024)) AS recommended FROM (SELECT doc_id, coalesce(length(text), 0)::BIGINT * 40 // 2 + 2048 AS t FROM documents)",
    "correction_replies": """
SELECT conv_id AS meeting_id, turn AS seq, md5(CASE WHEN conv_id % 5 = 0 THEN text WHEN length(text) < 200 AND trim(text) <> '' THEN trim(reverse(text), ' ' || chr(9) || chr(10) || chr(13)) WHEN 3 * length(text) > greatest(2 * length(text) + 20, 40) THEN text ELSE repeat(text, 3) END) AS digest FROM conversations""",
    "reply_titles": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN trim(p_name) ELSE '회의록' END AS title FROM part",
    "posting_phrases": f"WITH {M}, h AS (SELECT id, (length(lower(title)) - length(replace(lower(title), '{PHRASE.lower()}', '')) + length(lower(body)) - length(replace(lower(body), '{PHRASE.lower()}', ''))) // {len(PHRASE)} AS hits FROM d) SELECT id, hits::BIGINT AS hits FROM h WHERE hits > 0",
    "rules_all": r"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS w FROM conversations), r AS (SELECT list(w ORDER BY w) AS ws FROM w)
SELECT conv_id, turn, md5(list_reduce(list_prepend(text, ws), lambda t, w: replace(t, w, left(w, 3) || '~'))) AS digest FROM conversations, r""",
    "nearest_reference": """
WITH q AS (SELECT vec_id, label * 10 + vec_id % 10 AS ref, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT ref, i, avg(x) AS m FROM q GROUP BY 1, 2), c AS (SELECT ref, i, m / sqrt(sum(m * m) OVER (PARTITION BY ref)) AS m FROM m), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM q GROUP BY 1),
s AS (SELECT q.vec_id, c.ref, sum(q.x * c.m) AS d FROM q JOIN c USING (i) GROUP BY 1, 2)
SELECT vec_id, CASE WHEN d / n >= 0.2 THEN ref END AS ref, round(d / n, 5) AS similarity FROM s JOIN n USING (vec_id) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 12) DESC, ref) = 1""",
    "markdown_blocks": f"""
SELECT p_partkey, '<h2>' || p_name || '</h2>' || {_NL} || '<ul>' || {_NL} || '<li>☑ ' || p_name || '</li>' || {_NL} || '<ul>' || {_NL} || '<li><strong>' || p_brand || '</strong></li>' || {_NL} || '<ul>' || {_NL} || '<li>deep</li>' || {_NL} || '</ul>' || {_NL} || '</ul>'
  || {_NL} || '<li>☐ open</li>' || {_NL} || '</ul>' || {_NL} || '<p>one <em>' || p_type || '</em> two &amp; three</p>' || {_NL} || '<h1>end</h1>' AS html FROM part""",
}
