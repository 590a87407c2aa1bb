"""Connected components of an edge list by alternating large-star and small-star steps.

Edges are (a long, b long).  Every step is a pre-aggregated minimum per node and a
join back, never a collected neighbourhood, so a node of very many neighbours is
summed map-side and its join can be split.  Each round is a written table in the
shared folder.  Self-loops and repeated edges are allowed; no edges, no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): label is the smallest node of the component."""
    hi, lo = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = materialise(edges.filter("a <> b").select(hi, lo).distinct(), "edges")
    state = _state(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        now = materialise(_small_star(_large_star(now)), "edges")
        state, before = _state(now), state
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge points down (u > v), so the smaller neighbours of u are its own rows
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
