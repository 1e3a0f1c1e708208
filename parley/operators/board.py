"""Posts and their comments on a remote board: parents, counters, numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_parent(comments: DataFrame, posts: DataFrame, marker: str = "marker") -> DataFrame:
    """comments (comment_id, post_id) with their post's marker as parent_marker, null where the post is gone."""
    return comments.join(posts.select("post_id", F.col(marker).alias("parent_marker")), "post_id", "left")


def comment_counters(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Per post: comments (how many) and next_number, one above the highest number given so far; a post without comments starts at 1."""
    by = comments.groupBy("post_id").agg(F.count("*").alias("comments"), F.max("number").alias("top"))
    return posts.select("post_id").join(by, "post_id", "left").select("post_id", F.coalesce("comments", F.lit(0)).alias("comments"), (F.coalesce("top", F.lit(0)) + 1).cast("long").alias("next_number"))


def counts_after_delete(board: DataFrame, comments: DataFrame, gone: DataFrame) -> DataFrame:
    """board (board_id, posts, comments) once the posts in gone (board_id, post_id) are deleted with their comments; no count falls under 0."""
    lost = gone.select("board_id", "post_id").distinct().join(comments.groupBy("post_id").agg(F.count("*").alias("k")), "post_id", "left")
    by = lost.groupBy("board_id").agg(F.count("*").alias("p"), F.sum(F.coalesce("k", F.lit(0))).alias("c"))
    less = lambda a, b: F.greatest(F.col(a) - F.coalesce(b, F.lit(0)), F.lit(0)).alias(a)
    return board.join(by, "board_id", "left").select("board_id", less("posts", "p"), less("comments", "c"))


def numbered_posts(board: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """new posts (board_id, order) with number: each board goes on downwards from its least number, a board without posts from -1."""
    least = board.groupBy("board_id").agg(F.min("number").alias("least"))
    k = F.row_number().over(W.partitionBy("board_id").orderBy(order))
    return new.withColumn("k", k).join(least, "board_id", "left").withColumn("number", (F.coalesce("least", F.lit(0)) - F.col("k")).cast("long")).drop("k", "least")
