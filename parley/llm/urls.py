"""URL filter: host-suffix and path-prefix expressions joined on short hash prefixes.

A rule is (action, host, path). A different URL is expanded once, into the host suffixes with as many labels and the path prefixes with as many
characters as rules have; only the first digits of an expression's SHA-256 are joined on, the full digest then confirms, and of the
rules that fit, the longest wins (host + path; then the longer host; then block). Host and path are taken in each row; only the URLs that
a rule fits are joined back, by the URL's digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm._store import materialise, sent

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Hexadecimal digits of the digest that are joined on.
PREFIX = 8
#: Rules go to every task if a count shows that they are up to this many (some 100 bytes each, and their text). Beyond it both sides are shuffled, and
#: adaptive execution splits the rows of an expression that many share.
BROADCAST_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def fitting_rules(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """One row for each different URL that a rule fits: key (the URL's SHA-256), rule (host + path) and action of the one that wins.

    rules: action, host, path; nulls and hosts that hold no text fit nothing, nor does any rule a URL without a host.
    """
    given = rules.where("action is not null and host is not null and path is not null and host <> ''").dropDuplicates(["action", "host", "path"])
    given = given.select("action", "host", "path", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("size"))
    most = given.agg(F.max("labels").alias("most")).first()["most"] or 0
    shapes = given.select("labels", "size").distinct()
    seen = urls.select(F.col(url_col).alias("url")).where(host_of(F.col("url")) != "").distinct()
    seen = seen.select(F.sha2(F.col("url").cast("binary"), 256).alias("key"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ends = seen.select("*", F.explode(F.slice(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), 1, most)).alias("labels"))
    ends = ends.join(sent(shapes, BROADCAST_RULES), "labels").where(F.length("path") >= F.col("size"))
    digest = lambda h, p: F.sha2(F.concat_ws("\n", h, p).cast("binary"), 256)
    suffix = F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("labels"))
    expanded = ends.select("key", digest(suffix, F.substring("path", F.lit(1), F.col("size"))).alias("digest")).withColumn("short", F.substring("digest", 1, PREFIX))
    table = given.select(F.concat("host", "path").alias("rule"), "action", F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("nh"), digest("host", "path").alias("full")).withColumn("short", F.substring("full", 1, PREFIX))
    met = expanded.join(sent(table, BROADCAST_RULES), "short").where("digest = full")
    best = met.groupBy("key").agg(F.max(F.struct("n", "nh", "action", "rule")).alias("best"))
    return materialise(best.select("key", "best.rule", "best.action"), "url-rules")


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", keys: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """Every row of pages (its keys) with host, path, rule (host + path, else null) and verdict.

    No rule: the default. A null url, or one without ://, has an empty host and path, which no rule fits.
    """
    url = F.col(url_col)
    rows = pages.select(*keys, url.alias("__url"), host_of(url).alias("__host"), path_of(url).alias("__path"))
    fits = fitting_rules(pages, rules, url_col).withColumnsRenamed({"key": "__key", "rule": "__rule", "action": "__action"})
    # rows without a host meet no rule, so they stay out of the join however many they are
    asked = rows.where("__host <> ''").withColumn("__key", F.sha2(F.col("__url").cast("binary"), 256)).drop("__url")
    # what fits grows with the URLs, so it is never broadcast; a URL that many rows share is split by adaptive execution
    judged = asked.join(fits.hint("merge"), "__key", "left").drop("__key")
    judged = judged.unionByName(rows.where("__host = ''").drop("__url"), allowMissingColumns=True)
    return judged.select(*keys, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.coalesce("__action", F.lit(default)).alias("verdict"))


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each different url: url, host, path, rule, verdict, as filter_urls gives them."""
    return filter_urls(urls.select(F.col(url_col).alias("url")).distinct(), rules, keys=("url",), default=default)
