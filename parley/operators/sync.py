"""Publication state of meetings and utterances on several targets: roll-ups, what is due, upserts, and an event log folded into a state.

State frames are snapshots: each function returns the new one. Target rows: key (meeting_id or utterance_id), target, status, post_id, error, updated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT = "default"
RETRYABLE = ("pending", "partial", "failed")


def _place(target: str = "target") -> Column:
    return F.struct(F.when(F.col(target) == DEFAULT, 0).otherwise(1), F.col("updated"), F.col(target))


def rollup(targets: DataFrame, key: str = "meeting_id", utterances: bool = False) -> DataFrame:
    """Per key: status, post_id (of the default target, else of the one changed first), error ('target: error' joined, 2000 characters at most).

    All synced: synced. Else partial if one is synced (or, for meetings, partial, or has a post id), else failed if one has failed, else pending.
    """
    some = F.col("status").isin("synced") if utterances else F.col("status").isin("synced", "partial")
    has_id = F.coalesce(F.col("post_id"), F.lit("")) != ""
    has_error = F.coalesce(F.col("error"), F.lit("")) != ""
    by = targets.groupBy(key).agg(
        F.every(F.col("status") == "synced").alias("all_synced"),
        F.bool_or(some).alias("some"),
        F.bool_or(F.col("status") == "failed").alias("failed"),
        F.min_by(F.when(has_id, F.col("post_id")), F.when(has_id, _place())).alias("post_id"),
        F.array_sort(F.collect_list(F.when(has_error, F.struct(F.col("target"), F.col("error"))))).alias("errors"),
    )
    status = F.when(F.col("all_synced"), "synced").when(F.col("some") | (F.lit(not utterances) & F.col("post_id").isNotNull()), "partial").when(F.col("failed"), "failed").otherwise("pending")
    error = F.when(F.size("errors") > 0, F.substring(F.array_join(F.transform("errors", lambda e: F.concat(e["target"], F.lit(": "), e["error"])), "; "), 1, 2000))
    return by.select(key, status.alias("status"), "post_id", error.alias("error"))


def lookup(states: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """The states of the wanted keys."""
    return states.join(keys.select(*key).distinct(), key, "left_semi")


def unsynced(meetings: DataFrame, targets: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Meetings (meeting_id, sync_status) with work to do. With wanted targets: those not blocked of which one is missing or retryable."""
    if not wanted:
        return meetings.where(F.col("sync_status").isin(*RETRYABLE))
    names = [w for w in wanted if w]
    done = targets.where(F.col("target").isin(*names) & ~F.col("status").isin(*RETRYABLE)).groupBy("meeting_id").agg(F.countDistinct("target").alias("done"))
    return meetings.where(F.col("sync_status") != "blocked").join(done, "meeting_id", "left").where(F.coalesce("done", F.lit(0)) < len(set(names))).drop("done")


def refresh_targets(targets: DataFrame, utterances: DataFrame, states: DataFrame) -> DataFrame:
    """Each meeting target that has a post, recomputed from its utterances: status, error, pending (utterances not synced there yet).

    utterances: meeting_id, utterance_id, seq. states: utterance_id, target, status, post_id, error. Targets without a post are not returned.
    """
    posted = targets.where(F.coalesce("post_id", F.lit("")) != "").select("meeting_id", "target", "post_id")
    s = states.select("utterance_id", "target", "status", F.col("post_id").alias("comment_id"), "error")
    lines = posted.join(utterances.select("meeting_id", "utterance_id", "seq"), "meeting_id", "left").join(s, ["utterance_id", "target"], "left")
    open_ = F.col("utterance_id").isNotNull() & ((F.coalesce("comment_id", F.lit("")) == "") | ~F.coalesce(F.col("status") == "synced", F.lit(False)))
    told = F.when(F.coalesce("error", F.lit("")) != "", F.struct("seq", "error"))
    by = lines.groupBy("meeting_id", "target").agg(F.count_if(open_).alias("pending"), F.array_sort(F.collect_list(told)).alias("errors"))
    errors = F.when(F.size("errors") > 0, F.array_join(F.transform("errors", lambda e: F.concat(F.lit("seq="), e["seq"].cast("string"), F.lit(": "), e["error"])), "; "))
    error = F.coalesce(errors, F.when(F.col("pending") > 0, F.concat(F.col("pending").cast("string"), F.lit(" comments pending"))))
    return by.select("meeting_id", "target", F.when(F.col("pending") > 0, "partial").otherwise("synced").alias("status"), F.substring(error, 1, 2000).alias("error"), "pending")


def upsert(state: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """state with the rows of new put in: all columns from new, but an id that new does not give is kept."""
    other = [c for c in state.columns if c not in key]
    n = new.select(*key, F.lit(True).alias("__new"), *(F.col(c).alias(f"__{c}") for c in other))
    both = state.join(n, key, "full_outer")
    return both.select(*key, *(F.when(F.col("__new"), F.coalesce(f"__{c}", c) if c == "post_id" else F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in other))


def insert_missing(state: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """state with those rows of new whose key it lacks."""
    return state.unionByName(new.join(state.select(*key), key, "left_anti"))


def adopt_default(targets: DataFrame, name: str, now: Column, key: str = "meeting_id") -> DataFrame:
    """The state in which target name takes over what the default target has an id for: a missing row is copied from it, and a row without
    an id gets the default's id, status and error. updated becomes now in both. The default's own rows stay. An empty or default name changes nothing."""
    if not name.strip() or name.strip() == DEFAULT:
        return targets
    base = targets.where((F.col("target") == DEFAULT) & (F.coalesce("post_id", F.lit("")) != ""))
    copied = insert_missing(targets, base.withColumns({"target": F.lit(name.strip()), "updated": now.cast(targets.schema["updated"].dataType)}), [key, "target"])
    d = base.select(key, F.lit(name.strip()).alias("target"), *(F.col(c).alias(f"d_{c}") for c in ("post_id", "status", "error")))
    take = F.col("d_post_id").isNotNull() & (F.coalesce("post_id", F.lit("")) == "")
    out = copied.join(d, [key, "target"], "left")
    new = {**{c: F.col(f"d_{c}") for c in ("post_id", "status", "error")}, "updated": now.cast(targets.schema["updated"].dataType)}
    return out.select(*(F.when(take, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in targets.columns))


def fold_events(events: DataFrame, key: str = "meeting_id") -> DataFrame:
    """An append-only log (key, target, status, post_id, error, event) as a state: the last status and error, the last id that was given."""
    has = F.coalesce(F.col("post_id"), F.lit("")) != ""
    return events.groupBy(key, "target").agg(F.max_by("status", "event").alias("status"), F.max_by(F.when(has, F.col("post_id")), F.when(has, F.col("event"))).alias("post_id"), F.max_by(F.struct(F.col("error").alias("e")), "event")["e"].alias("error"), F.max("event").alias("updated"))


def mark_failed(meetings: DataFrame, ids: DataFrame) -> DataFrame:
    """meetings (meeting_id, sync_status, sync_error) in which those of ids (meeting_id, error) have failed as such, where no target is to blame."""
    return _marked(meetings, ids, "failed")


def _marked(meetings: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    hit = ids.groupBy("meeting_id").agg(F.max(F.substring("error", 1, 2000)).alias("told"), F.lit(True).alias("hit"))
    both = meetings.join(hit, "meeting_id", "left").withColumn("sync_status", F.when(F.col("hit"), status).otherwise(F.col("sync_status")))
    return (both.withColumn("sync_error", F.when(F.col("hit"), F.col("told")).otherwise(F.col("sync_error"))) if "sync_error" in meetings.columns else both).drop("told", "hit")


def block(meetings: DataFrame, targets: DataFrame, ids: DataFrame, wanted: list[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """The states in which the uploads of some meetings (meeting_id, error) are blocked on the wanted targets. No roll-up: meetings are blocked as such."""
    new = ids.select("meeting_id", F.explode(F.array(*(F.lit(w) for w in wanted or [DEFAULT]))).alias("target"), F.lit("blocked").alias("status"), F.lit(None).cast("string").alias("post_id"), F.substring("error", 1, 2000).alias("error"), now.alias("updated"))
    return _marked(meetings, ids, "blocked"), upsert(targets, new, ["meeting_id", "target"])


def approve(meetings: DataFrame, targets: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Releases blocked meetings (meeting_id): new meetings, new targets, and the ids for which that changed something. What was blocked waits again, without its error."""
    changed = meetings.where(F.col("sync_status") == "blocked").join(ids.select("meeting_id").distinct(), "meeting_id", "left_semi").select("meeting_id")
    hit = changed.withColumn("hit", F.lit(True))

    def pending(df: DataFrame, status: str, error: str) -> DataFrame:
        freed = F.coalesce(F.col("hit") & (F.col(status) == "blocked"), F.lit(False))
        new = {error: F.when(~freed, F.col(error)), status: F.when(freed, "pending").otherwise(F.col(status))}
        return df.join(hit, "meeting_id", "left").select(*((new[c].alias(c) if c in new else F.col(c)) for c in df.columns))

    return pending(meetings, "sync_status", "sync_error"), pending(targets, "status", "error"), changed


def dedupe_by_key(rows: DataFrame, seen: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """The first row of each key that is not in seen."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    return first.join(seen.select(key), key, "left_anti")
