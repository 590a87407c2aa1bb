"""Running sums and order statistics of a whole table, or of each of its groups, without a task that takes all rows.

Rows are range-partitioned by (group, value) and written, so every step sees one
division.  Each range's sums are a row; the sums of the ranges before it are added to
those inside it.  The only window that goes across ranges runs over a row per range.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise


def running(rows: DataFrame, order: str, sums: list[str], by: list[str] = []) -> DataFrame:
    """``rows`` (one per group and value of ``order``) with, for each column s of ``sums``, ``_to_s`` (sum up to and
    with this row, by rising ``order``), ``_all_s`` (of the group), and ``_before``: the value before this one."""
    ranges = materialise(rows.repartitionByRange(*by, order).withColumn("_p", F.spark_partition_id()), "ordered")
    keys = [F.col(b).alias(f"_by_{b}") for b in by]
    parts = ranges.groupBy(*keys, F.col("_p").alias("_q")).agg(F.max(order).alias("_most"), *[F.sum(s).alias(f"_t_{s}") for s in sums])  # a row per range and group in it
    across = Window.partitionBy(*[f"_by_{b}" for b in by]) if by else Window.partitionBy()
    earlier = across.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    summed = [c for s in sums for c in (F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_e_{s}"), F.sum(f"_t_{s}").over(across).alias(f"_all_{s}"))]
    parts = parts.select(*[f"_by_{b}" for b in by], "_q", F.lag("_most").over(across.orderBy("_q")).alias("_last"), *summed)
    same = reduce(and_, [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by], F.col("_p") == F.col("_q"))
    inside = Window.partitionBy(*by, "_p").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranges.join(parts, same).withColumns({**{f"_to_{s}": F.sum(s).over(upto) + F.col(f"_e_{s}") for s in sums}, "_before": F.coalesce(F.lag(order).over(inside), "_last")})
    return out.drop("_p", "_q", "_last", *[f"_by_{b}" for b in by], *[f"_e_{s}" for s in sums])


def order_statistics(df: DataFrame, value: str, indexes: dict[str, Column], by: list[str] = []) -> DataFrame:
    """Per group the values at 0-based places of the rising order; a place may depend on ``_n``, the group's number of values.

    Equal values are counted before anything is ordered.  Nulls take no part; a group
    without values has no row, nor has an empty table.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    rows = running(counted, value, ["c"], by).withColumnRenamed("_all_c", "_n")
    at = {k: F.max(F.when((i < F.col("_to_c")) & (i >= F.col("_to_c") - F.col("c")), F.col(value))).alias(k) for k, i in indexes.items()}
    found = rows.groupBy(*by).agg(*at.values(), F.count("*").alias("_c"))
    return found.filter("_c > 0").drop("_c")


def nearest_rank(q: float) -> Column:
    """Place of the least value that ``q`` percent of the values do not exceed."""
    return F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.ceil(F.lit(q / 100) * F.col("_n")) - 1))


def floor_index(q: float) -> Column:
    return F.least(F.col("_n") - 1, F.floor(F.lit(q) * F.col("_n")))


def rounded_rank(q: float) -> Column:
    return F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.bround(F.lit(q / 100) * F.col("_n") + 0.5).cast("long") - 1))
