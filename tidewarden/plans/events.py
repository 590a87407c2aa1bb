"""Queries of the event-store family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, store
from ..streaming import online
from .evaluation import rounded
from .frames import STORE_EVENTS, STORE_FEEDBACK, STORE_VERDICTS, duck, view

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_S = f"ev AS ({duck(STORE_EVENTS)}), ve AS ({duck(STORE_VERDICTS)}), fb AS ({duck(STORE_FEEDBACK)})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _store(spark, sf):
    ev, ve, fb = (view(spark, sf, q, "events") for q in (STORE_EVENTS, STORE_VERDICTS, STORE_FEEDBACK))
    timings = F.map_from_arrays(F.array(F.lit("perceive"), F.lit("rules")), F.array(F.col("perceive_ms"), F.col("rules_ms")))
    return ev, ve.withColumn("timings_ms", timings), fb


@query(f"WITH {_S} SELECT ve.event_id, verdict, category, parent_id FROM ve JOIN ev ON ve.event_id = ev.id")
def verdict_lookup(spark, sf):
    ev, ve, _ = _store(spark, sf)
    return store.verdicts_with_parent(ve, ev).select("event_id", "verdict", "category", "parent_id")


@query(f"WITH {_S}, m AS (SELECT created_at FROM ev ORDER BY created_at DESC LIMIT 1) SELECT ev.id, parent_id, channel, verdict, round(p_scam, 6) AS p_scam FROM ev LEFT JOIN ve ON ev.id = ve.event_id WHERE created_at >= (SELECT max(created_at) FROM ev) - INTERVAL 5 DAY")
def events_since(spark, sf):
    ev, ve, _ = _store(spark, sf)
    since = ev.agg(F.max("created_at") - F.expr("INTERVAL 5 DAYS")).first()[0]
    return rounded(store.events_since(ev, ve, F.lit(since)).select("id", "parent_id", "channel", "verdict", "p_scam"), "p_scam")


@query(f"WITH {_S} SELECT event_id, rules_ms, perceive_ms FROM ve JOIN ev ON ve.event_id = ev.id ORDER BY created_at DESC, event_id DESC LIMIT 50")
def recent_timings(spark, sf):
    ev, ve, _ = _store(spark, sf)
    return store.recent_timings(ev, ve).select("event_id", F.col("timings_ms")["rules"].alias("rules_ms"), F.col("timings_ms")["perceive"].alias("perceive_ms"))


@query(f"WITH {_S} SELECT id, parent_id, verdict FROM ev JOIN ve ON ev.id = ve.event_id WHERE NOT EXISTS (SELECT 1 FROM fb WHERE fb.event_id = ev.id)")
def pending_feedback_all(spark, sf):
    return store.pending_feedback(*_store(spark, sf), limit=None).select("id", "parent_id", "verdict")


@query(f"WITH {_S} SELECT id, parent_id, verdict FROM ev JOIN ve ON ev.id = ve.event_id WHERE NOT EXISTS (SELECT 1 FROM fb WHERE fb.event_id = ev.id) ORDER BY created_at DESC, id DESC LIMIT 20")
def pending_feedback(spark, sf):
    return store.pending_feedback(*_store(spark, sf)).select("id", "parent_id", "verdict")


@query(f"WITH {_S} SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey IN (SELECT id FROM ev)")
def event_exists(spark, sf):
    ev, _, _ = _store(spark, sf)
    return store.exists(ev, spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("id")).distinct())


@query(f"WITH {_S}, w AS (SELECT parent_id, channel, id, row_number() OVER (PARTITION BY parent_id, channel ORDER BY created_at DESC, id DESC) AS k FROM ev) SELECT parent_id, channel, id FROM w WHERE k = 1")
def latest_per_key(spark, sf):
    ev, _, _ = _store(spark, sf)
    return store.latest(ev, ["parent_id", "channel"], [F.desc("created_at"), F.desc("id")]).select("parent_id", "channel", "id")


_TILE = "CASE WHEN verdict IN ('SCAM','SUSPICIOUS','SAFE') THEN verdict ELSE 'UNKNOWN' END"


@query(f"WITH {_S}, p AS (SELECT DISTINCT concat('p', CAST(x AS VARCHAR)) AS parent_id FROM range(0, 9) t(x)), j AS (SELECT parent_id, {_TILE} AS v FROM ev JOIN ve ON ev.id = ve.event_id) SELECT p.parent_id, " + ", ".join(f"count(*) FILTER (j.v = '{c}') AS {c}" for c in ("SCAM", "SUSPICIOUS", "SAFE", "UNKNOWN")) + " FROM p LEFT JOIN j ON p.parent_id = j.parent_id GROUP BY p.parent_id")
def parent_tiles(spark, sf):
    ev, ve, _ = _store(spark, sf)
    parents = spark.range(9).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"))
    return store.parent_tiles(parents, store.verdicts_with_parent(ve, ev))


@query(f"WITH {_S}, k AS (SELECT CASE WHEN perceive_ms > 0 THEN 'media' ELSE 'text' END AS kind, perceive_ms + rules_ms AS total FROM ve) SELECT kind, count(*) AS n, max(total) AS max_ms, percentile_disc(0.95) WITHIN GROUP (ORDER BY total) AS p95 FROM k GROUP BY kind")
def split_totals(spark, sf):
    _, ve, _ = _store(spark, sf)
    return store.split_totals(ve, ["perceive", "rules"]).groupBy("kind").agg(F.count("*").alias("n"), F.max("total_ms").alias("max_ms"), metrics.nearest_rank("total_ms", 95).alias("p95"))


@query(f"WITH {_S} SELECT parent_id, CAST(created_at AS DATE) AS day, verdict, count(*) AS count FROM ev JOIN ve ON ev.id = ve.event_id GROUP BY 1, 2, 3")
def day_counts(spark, sf):
    ev, ve, _ = _store(spark, sf)
    rows = ev.join(ve.select(F.col("event_id").alias("id"), "verdict"), "id")
    return online.day_counts(rows).select("parent_id", F.to_date("day.start").alias("day"), "verdict", "count")


@query(f"WITH {_S}, u AS (SELECT parent_id, channel, text, max(created_at) AS used FROM ev GROUP BY 1, 2, 3), w AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY used DESC, text DESC) AS place FROM (SELECT parent_id, text, max(used) AS used FROM u GROUP BY 1, 2)) SELECT parent_id, text, place FROM w WHERE place <= 5")
def recent_list(spark, sf):
    ev, _, _ = _store(spark, sf)
    return store.most_recent(ev, "parent_id", "text", "created_at").select("parent_id", "text", "place")


@query(f"WITH {_S} SELECT event_id, perceive_ms + rules_ms AS total FROM ve")
def filled_timings(spark, sf):
    _, ve, _ = _store(spark, sf)
    return ve.select("event_id", store.filled_timings(F.col("timings_ms"), list(online.STAGES))["total"].alias("total"))


@query("SELECT l_orderkey, count(*) AS count FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return store.duplicate_keys(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_orderkey")


@query(f"WITH {_S} SELECT id, concat('Scam warning for ', parent_id, ': ', category, ' at ', strftime(created_at, '%H:%M')) AS body FROM ev JOIN ve ON ev.id = ve.event_id WHERE verdict = 'SCAM'")
def alert_bodies(spark, sf):
    ev, ve, _ = _store(spark, sf)
    rows = ev.join(ve.select(F.col("event_id").alias("id"), "verdict", "category"), "id")
    parents = spark.range(9).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id")).withColumn("name", F.col("id"))
    return online.alerts(rows, parents).select("id", "body")
