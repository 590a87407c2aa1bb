"""Threshold search by sweeping the observed scores.

Fusion at a threshold t says SCAM where a hard rule fired or p_scam >= t, so counts at
every candidate are cumulative sums over distinct scores: rows are grouped by score
first, and the sums run over ranges of the distinct scores (ordered.running), so no
task takes them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running


def _sweep(cases: DataFrame, score: str, forced: Column, hit: Column, miss: Column, sentinel: float | None) -> DataFrame:
    """Per candidate t: rows of ``hit`` and of ``miss`` that are forced or score >= t."""
    rows = cases.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("t")).agg(F.count_if(~forced & hit).alias("h"), F.count_if(~forced & miss).alias("m"))
    if sentinel is not None:
        rows = rows.unionByName(cases.sparkSession.createDataFrame([(float(sentinel), 0, 0)], "t double, h long, m long")).groupBy("t").agg(F.sum("h").alias("h"), F.sum("m").alias("m"))
    base = cases.agg(F.count_if(forced & hit).alias("h0"), F.count_if(forced & miss).alias("m0"), F.count_if(hit).alias("n_hit"), F.count_if(miss).alias("n_miss"), F.count(score).alias("n_scored"))
    from_top = lambda s: (F.col(f"_all_{s}") - F.col(f"_to_{s}") + F.col(s)).alias(s)
    swept = running(rows, "t", ["h", "m"]).select("t", from_top("h"), from_top("m"), F.col("_before").alias("before"))
    return swept.crossJoin(F.broadcast(base)).select("t", F.coalesce("before", F.lit(0.0)).alias("before"), (F.col("h") + F.col("h0")).alias("hits"), (F.col("m") + F.col("m0")).alias("misses"), "n_hit", "n_miss", "n_scored")


def t_high(cases: DataFrame, max_fpr: float = 0.03) -> DataFrame:
    """edge, low, high, value, feasible: the lowest candidate whose SAFE share called SCAM is small enough.

    The interval runs up over the candidates next to it with the same SCAM hits; the
    value is its midpoint.  One row; all null without gold SAFE or without scores.
    Cases: label, p_scam, p_safe, hard (array), soft (array).
    """
    forced = F.size("hard") > 0
    swept = _sweep(cases, "p_scam", forced, F.col("label") == "SCAM", F.col("label") == "SAFE", 1.0).withColumn("ok", F.col("misses") <= max_fpr * F.col("n_miss"))
    edge = swept.agg(F.min(F.when(F.col("ok"), F.struct("t", "before", "hits"))).alias("e"), F.max(F.struct("t", "before", "hits")).alias("last"), F.max("n_miss").alias("n_miss"), F.max("n_scored").alias("n_scored"))
    edge = edge.select(F.coalesce("e", "last").alias("e"), F.col("e").isNotNull().alias("feasible"), ((F.col("n_miss") > 0) & (F.col("n_scored") > 0)).alias("known"))
    run = swept.crossJoin(F.broadcast(edge)).filter((F.col("t") >= F.col("e.t")) & (F.col("hits") == F.col("e.hits")))
    return run.groupBy("e", "feasible", "known").agg(F.max("t").alias("top")).select(
        *[F.when(F.col("known"), c).alias(n) for n, c in (("edge", F.col("e.t")), ("low", F.col("e.before")), ("high", F.col("top")), ("value", F.when(F.col("feasible"), (F.col("e.before") + F.col("top")) / 2).otherwise(F.col("e.t"))), ("feasible", F.col("feasible")))]
    )


def t_low(cases: DataFrame, high: float, min_recall: float = 0.98, cap: float = 0.5) -> DataFrame:
    """edge, low, high, uncapped, value, feasible: the highest candidate risk that still flags enough.

    Flagged: a hard rule, p_scam >= high, two soft signals, or risk >= t.
    """
    risk = F.coalesce(1 - F.col("p_safe"), F.col("p_scam"))
    rows = cases.withColumn("risk", risk)
    forced = (F.size("hard") > 0) | F.coalesce(F.col("p_scam") >= high, F.lit(False)) | (F.col("risk").isNotNull() & (F.size("soft") >= 2)) | (F.col("risk").isNull() & (F.size("soft") > 0))
    swept = _sweep(rows, "risk", forced, F.col("label").isin("SCAM", "SUSPICIOUS"), F.col("label") == "SAFE", None).withColumn("ok", F.col("hits") >= min_recall * F.col("n_hit"))
    edge = swept.agg(F.max(F.when(F.col("ok"), F.struct("t", "misses"))).alias("e"), F.min(F.struct("t", "misses")).alias("first"), F.max("n_hit").alias("n_hit"), F.max("n_scored").alias("n_scored"))
    edge = edge.select(F.coalesce("e", "first").alias("e"), F.col("e").isNotNull().alias("feasible"), ((F.col("n_hit") > 0) & (F.col("n_scored") > 0)).alias("known"))
    run = swept.crossJoin(F.broadcast(edge)).filter((F.col("t") <= F.col("e.t")) & (F.col("misses") == F.col("e.misses")))
    found = run.groupBy("e", "feasible", "known").agg(F.min("before").alias("low"))
    raw = F.when(F.col("feasible"), (F.col("low") + F.col("e.t")) / 2).otherwise(F.col("e.t"))
    return found.select(*[F.when(F.col("known"), c).alias(n) for n, c in (("edge", F.col("e.t")), ("low", F.col("low")), ("high", F.col("e.t")), ("uncapped", raw), ("value", F.least(raw, F.lit(cap))), ("feasible", F.col("feasible")))])
