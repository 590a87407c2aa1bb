"""Look-alike names: all pairs within a small edit distance, by a deletion-neighbourhood join.

Two names within distance d come to one string if at most d signs are dropped from
each.  So every name gets the strings it can be cut to as keys, an equi-join on the keys
finds all pairs within the distance and some beyond, and the distance itself decides.
The work grows with the names and the official domains, not with their product; neither
side is collected, and neither is broadcast unless Spark finds it small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distance allowed: of a domain whose first label has so many signs at most, and of all others.
SHORT_LABEL, SHORT_DISTANCE, DISTANCE = 4, 1, 2


def allowed_distance(domain: Column) -> Column:
    return F.when(F.length(F.split_part(domain, F.lit("."), F.lit(1))) <= SHORT_LABEL, SHORT_DISTANCE).otherwise(DISTANCE)


def _cut(name: Column) -> Column:
    """The name without one of its signs, each in turn."""
    return F.when(F.length(name) > 0, F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1)))).otherwise(F.array().cast("array<string>"))


def cut_keys(name: Column, most: Column) -> Column:
    """What is left of the name when ``most`` signs (0 to 2) or fewer are dropped."""
    once = F.array_distinct(_cut(name))
    twice = F.array_distinct(F.flatten(F.transform(once, _cut)))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(name), F.when(most >= 1, once).otherwise(none), F.when(most >= 2, twice).otherwise(none)))


def lookalikes(names: DataFrame, domains: DataFrame, name: str = "name", domain: str = "domain") -> DataFrame:
    """name, domain, distance: distinct pairs that are close but not equal; null and empty names have none."""
    some = lambda df, c: df.select(F.col(c).alias(c)).filter(F.coalesce(F.col(c), F.lit("")) != "").distinct()
    left = some(names, name).select(name, F.explode(cut_keys(F.col(name), F.lit(DISTANCE))).alias("key"))
    right = some(domains, domain).withColumn("most", allowed_distance(F.col(domain))).select(domain, "most", F.explode(cut_keys(F.col(domain), F.col("most"))).alias("key"))
    near = F.abs(F.length(name) - F.length(domain)) <= F.col("most")
    pairs = left.join(right, "key").filter(near).select(name, domain, "most").distinct()
    distance = F.levenshtein(F.col(name), F.col(domain))
    return pairs.withColumn("distance", distance).filter((F.col("distance") >= 1) & (F.col("distance") <= F.col("most"))).select(name, domain, "distance")


def with_lookalikes(rows: DataFrame, name: str, domains: DataFrame, domain: str = "domain") -> DataFrame:
    """The rows with ``resembles``: the nearest official domain their name is close to (ties: the first in order), else null."""
    best = lookalikes(rows, domains, name, domain).groupBy(name).agg(F.min_by(domain, F.struct("distance", domain)).alias("resembles"))
    return rows.join(best, name, "left")
