"""Event store: lookups, joins, latest rows, tiles and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import VERDICTS


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row per key: upserts and label logs."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def verdict_of(verdicts: DataFrame, events: DataFrame, event_id) -> DataFrame:
    own = verdicts.filter(F.col("event_id") == event_id)
    return own.join(events.select(F.col("id").alias("event_id"), "parent_id"), "event_id")


def verdicts_with_parent(verdicts: DataFrame, events: DataFrame) -> DataFrame:
    return verdicts.join(events.select(F.col("id").alias("event_id"), "parent_id"), "event_id")


def events_since(events: DataFrame, verdicts: DataFrame, since) -> DataFrame:
    """Events from a time on with their verdict's columns or nulls; metadata only, no text."""
    meta = events.filter(F.col("created_at") >= since).select("id", "parent_id", "created_at", "channel")
    return meta.join(verdicts.select(F.col("event_id").alias("id"), "verdict", "category", "p_scam", "timings_ms"), "id", "left")


def recent_timings(events: DataFrame, verdicts: DataFrame, limit: int = 50) -> DataFrame:
    joined = verdicts.join(events.select(F.col("id").alias("event_id"), "created_at"), "event_id")
    return joined.orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit).select("event_id", "created_at", "timings_ms")


def pending_feedback(events: DataFrame, verdicts: DataFrame, feedback: DataFrame, limit: int | None = 20) -> DataFrame:
    """Events with a verdict and no feedback, newest first."""
    rows = events.select("id", "parent_id", "created_at").join(verdicts.select(F.col("event_id").alias("id"), "verdict"), "id").join(feedback.select(F.col("event_id").alias("id")), "id", "left_anti")
    return rows if limit is None else rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def exists(events: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(events.select("id"), "id", "left_semi")


def parent_tiles(parents: DataFrame, rows: DataFrame) -> DataFrame:
    """Per parent the number of each verdict; unknown ones are UNKNOWN, absent ones 0."""
    known = F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise("UNKNOWN")
    counts = rows.select("parent_id", known.alias("v")).groupBy("parent_id").pivot("v", list(VERDICTS)).count()
    return parents.select(F.col("id").alias("parent_id")).join(counts, "parent_id", "left").na.fill(0, list(VERDICTS))


def split_totals(rows: DataFrame, stages: list[str]) -> DataFrame:
    """kind (media where the perceive stage took time, else text) and the total of the row's stages."""
    t = F.col("timings_ms")
    total = F.aggregate(F.map_values(t), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return rows.select("*", F.when(F.coalesce(t["perceive"], F.lit(0)) > 0, "media").otherwise("text").alias("kind"), total.alias("total_ms"), *[F.nullif(t[s], F.lit(0).cast("bigint")).alias(f"{s}_ms") for s in stages])


def filled_timings(timings: Column, stages: list[str]) -> Column:
    """All stages, zero where absent, and their total."""
    full = [F.coalesce(timings[s], F.lit(0).cast("bigint")) for s in stages]
    return F.map_from_arrays(F.array(*map(F.lit, (*stages, "total"))), F.array(*full, sum(full[1:], full[0])))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().filter("count > 1")


def most_recent(df: DataFrame, user: str, key: str, at: str, keep: int = 5) -> DataFrame:
    """Per user the ``keep`` most recently used distinct keys."""
    last = df.groupBy(user, key).agg(F.max(at).alias(at))
    w = Window.partitionBy(user).orderBy(F.desc(at), F.desc(key))
    return last.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep)
