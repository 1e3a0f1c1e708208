"""Keyword counts and the comparison of two meetings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HANGUL = "[가-힣]{2,12}"
# Words that are no keywords in Korean talk.
STOP_WORDS = (
    "있는 있다 있습니다 있어 있고 있을 있어요 없는 없다 없습니다 없어 하는 하고 하지 하면 하기 한다 되는 되어 되고 되면 된다 같은 같이 같다 "
    "그런 그래서 그러나 그리고 그러면 그것 그거 이런 이거 이게 이렇게 정말 진짜 아주 매우 조금 약간 거의 많이 별로 다시 이제 지금 오늘 내일 어제 "
    "통해 위해 대해 대한 통한 위한 수가 수도 수는 것이 것은 것을 것도 어떻게 어떤 무엇 어디 언제 회의 말씀 부분 내용 이야기 얘기 생각 "
    "우리 우리가 우리는 우리도 우리를 우리에게 우리의 우리들 우리들이 저희 저희가 저희는 저희도 저희들 저희들이 저희를 제가 저는 저도 저를 저의 본인 본인이 본인의 "
    "아까 이미 이번 이번에 이번에는 보니 보니까 보면 보는 해서 해도 해야 해야지 하니까 하면서 하기에 하기로 하기에는 가지 가지고 가지는 가지면 가지를 "
    "정도 관련 경우 측면 차원 그래도 그러니까 그러므로 그러기에 그러면서 있도록 있는데 있고요 있구요 있으면 있어서 없고 없는데 하겠습니다 하겠다 할게요 할까요 한다고 하는데 하기는 "
    "되면서 되었습니다 됩니다 되는데 되어야 되어서 같아요 같습니다 같아서 드립니다 드리고 드릴 드린 드리면 주세요 주시기 주시면 한번 두번 여러 다른 저런 어느 여기 거기 저기 처음 마지막"
).split()


def words(texts: DataFrame, key: list[str], pattern: str = HANGUL, lower: bool = False, without: set[str] | None = None) -> DataFrame:
    """texts: key columns, seq (a whole number), text. One row for each match of pattern that is not in without: key columns, word, place (ordered as seq, then
    position; one number, so that its least is kept in a hash table)."""
    text = F.coalesce(F.lower("text") if lower else F.col("text"), F.lit(""))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    if without:
        found = F.filter(found, lambda x: ~x["word"].isin(*without))
    place = F.col("seq").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("x.at")
    return texts.select(*key, "seq", F.explode(found).alias("x")).select(*key, "x.word", place.alias("place"))


def top_keywords(texts: DataFrame, key: list[str] | None = None, top: int = 30, least: int = 2, exclude: list[str] | None = None, pattern: str = HANGUL, lower: bool = False) -> DataFrame:
    """The top words by count (of equals the first to appear) for each key, then those of least occurrences: key, word, n, rank.

    The cut to top comes before the test of least. exclude: words left out beside STOP_WORDS.
    """
    key = key or []
    counted = words(texts, key, pattern, lower, {*STOP_WORDS, *(exclude or [])}).groupBy(*key, "word").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    if not key:  # a top list over all: sorted as such, no window over everything
        counted = counted.orderBy(F.desc("n"), "place", "word").limit(top)
        ranked = counted.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "place", "word")))
    else:
        ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("n"), "place", "word"))).where(F.col("rank") <= top)
    return ranked.where(F.col("n") >= least).select(*key, "word", "n", F.col("rank").cast("long").alias("rank"))


def compare_two(texts: DataFrame, a: int, b: int, kind: str = "word", top: int = 50, show: int = 20, **options) -> DataFrame:
    """What two meetings (or sources: column meeting_id) have in common and apart: kind (speaker or word), side (both, a, b), item, n_a, n_b, rank.

    Words are the top ones of each side; of each side show are given, by count, then by the word.
    """
    both = texts.where(F.col("meeting_id").isin(a, b))
    tops = top_keywords(both, ["meeting_id"], top, 1, **options).select("meeting_id", F.col("word").alias("item"), "n", F.lit("word").alias("kind"))
    speakers = both.where(F.col("speaker").isNotNull()).groupBy("meeting_id", F.col("speaker").alias("item")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("speaker"))
    of = lambda m, c: F.max(F.when(F.col("meeting_id") == m, F.col("n"))).alias(c)
    paired = tops.unionByName(speakers).groupBy("kind", "item").agg(of(a, "n_a"), of(b, "n_b"))
    side = F.when(F.col("n_a").isNull(), "b").when(F.col("n_b").isNull(), "a").otherwise("both")
    count = F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))
    rank = F.row_number().over(W.partitionBy("kind", "side").orderBy(F.desc("count"), "item"))
    return paired.withColumns({"side": side, "count": count}).withColumn("rank", rank.cast("long")).where(F.col("rank") <= show).select("kind", "side", "item", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), "rank")


def compare_totals(utterances: DataFrame, a: int, b: int) -> DataFrame:
    """The other half of the comparison: duration_ms, speakers and utterances of each of the two."""
    both = utterances.where(F.col("meeting_id").isin(a, b))
    return both.groupBy("meeting_id").agg((F.max("end_ms") - F.min("start_ms")).alias("duration_ms"), F.countDistinct("speaker").alias("speakers"), F.count("*").alias("utterances"))


def contains_any(text: Column, parts: list[str]) -> Column:
    """Case-sensitive: does text hold one of parts?"""
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out
