"""Classifier metrics over a frame of gold and predicted columns.

Columns: gold_verdict, pred_verdict, gold_category, pred_category, hard_negative,
json_valid, json_parsed, error; gold_quotes and pred_quotes (arrays) with text and id
for span and grounding metrics.  An empty denominator gives null, never 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORD
from ..functions.vocab import DETECTOR_VERDICTS, VERDICTS
from ..sources.shared import arrow_rows, materialise
from . import ordered
from .ordered import floor_index, rounded_rank  # noqa: F401  (percentile_at's indexes)

FLAGGED = ("SCAM", "SUSPICIOUS")


def how_many(which: Column, weight: Column | None = None) -> Column:
    """Rows that meet a condition; with a weight a row stands for so many."""
    return F.count_if(which) if weight is None else F.coalesce(F.sum(F.when(which, weight)), F.lit(0))


def rate(hit: Column, among: Column, weight: Column | None = None) -> Column:
    return F.try_divide(how_many(hit & among, weight), how_many(among, weight))


def scam_recall(strict: bool = False, weight: Column | None = None) -> Column:
    hit = F.col("pred_verdict") == "SCAM" if strict else F.col("pred_verdict").isin(*FLAGGED)
    return rate(hit, F.col("gold_verdict") == "SCAM", weight)


def fpr_genuine(hard: bool = False, weight: Column | None = None) -> Column:
    among = F.col("gold_verdict") == "SAFE"
    return rate(F.col("pred_verdict").isin(*FLAGGED), among & F.col("hard_negative") if hard else among, weight)


def category_accuracy(weight: Column | None = None) -> Column:
    return rate(F.col("pred_category").eqNullSafe(F.col("gold_category")), F.col("gold_verdict") == "SCAM", weight)


def applicable_rate(flag: str) -> Column:
    return F.avg(F.col(flag).cast("int"))


def unknown_rate(weight: Column | None = None) -> Column:
    return rate(~F.col("pred_verdict").isin(*DETECTOR_VERDICTS), F.lit(True), weight)


def macro_f1(unknown_as: str | None = None, weight: Column | None = None) -> Column:
    """Mean F1 of the classes that occur in gold or predictions."""
    pred = F.when(F.col("pred_verdict").isin(*DETECTOR_VERDICTS), F.col("pred_verdict")).otherwise(unknown_as or "UNKNOWN")
    total, classes = F.lit(0.0), F.lit(0)
    for c in DETECTOR_VERDICTS:
        tp = how_many((F.col("gold_verdict") == c) & (pred == c), weight)
        all_ = how_many(F.col("gold_verdict") == c, weight) + how_many(pred == c, weight)  # 2 tp + fp + fn
        total = total + F.coalesce(F.try_divide(2 * tp, all_), F.lit(0.0))
        classes = classes + (all_ > 0).cast("int")
    return F.try_divide(total, classes)


HEADLINE = {
    "scam_recall": scam_recall, "strict_scam_recall": lambda **w: scam_recall(True, **w), "fpr_genuine": fpr_genuine, "fpr_hard_negative": lambda **w: fpr_genuine(True, **w),
    "macro_f1": macro_f1, "category_accuracy": category_accuracy, "unknown_rate": unknown_rate,
}


def rollup() -> list[Column]:
    """Every single-pass metric and the counts behind them."""
    counts = {
        "n": F.count("*"), "n_scam": F.count_if(F.col("gold_verdict") == "SCAM"), "n_suspicious": F.count_if(F.col("gold_verdict") == "SUSPICIOUS"),
        "n_genuine": F.count_if(F.col("gold_verdict") == "SAFE"), "n_hard_negative": F.count_if((F.col("gold_verdict") == "SAFE") & F.col("hard_negative")),
        "json_validity": applicable_rate("json_valid"), "json_parse_rate": applicable_rate("json_parsed"), "n_errors": F.count("error"),
    }
    return [c.alias(k) for k, c in {**{k: f() for k, f in HEADLINE.items()}, **counts}.items()]


def per_class_f1(df: DataFrame) -> DataFrame:
    rows = df.select(F.explode(F.array(*map(F.lit, DETECTOR_VERDICTS))).alias("class"), "gold_verdict", "pred_verdict")
    g, p = F.col("gold_verdict") == F.col("class"), F.col("pred_verdict") == F.col("class")
    found = rows.groupBy("class").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    return found.filter("tp + fp + fn > 0").withColumn("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))


def tokens(quotes: Column) -> Column:
    return F.flatten(F.transform(quotes, lambda q: F.regexp_extract_all(F.lower(q), F.lit(WORD + "+"), 0)))


def span_f1(df: DataFrame) -> DataFrame:
    """One row: micro precision, recall and F1 over token multisets of the items with gold quotes."""
    some = df.filter(F.size("gold_quotes") > 0).select("id", tokens(F.col("gold_quotes")).alias("g"), tokens(F.col("pred_quotes")).alias("p"))
    long = some.select("id", F.explode("g").alias("token"), F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(some.select("id", F.explode("p").alias("token"), F.lit(0).alias("g"), F.lit(1).alias("p")))
    sums = long.groupBy("id", "token").agg(F.sum("g").alias("g"), F.sum("p").alias("p")).agg(F.sum(F.least("g", "p")).alias("both"), F.sum("g").alias("gold"), F.sum("p").alias("pred"))
    p, r = F.try_divide("both", "pred"), F.try_divide("both", "gold")
    f1 = F.when(F.coalesce("gold", F.lit(0)) == 0, None).when(F.col("both") == 0, 0.0).otherwise(F.try_divide(2 * F.col("both"), F.col("pred") + F.col("gold")))
    return sums.select(p.alias("precision"), r.alias("recall"), f1.alias("span_f1"))


def grounding_rate() -> Column:
    quotes = F.coalesce("pred_quotes", F.array().cast("array<string>"))
    good = F.size(F.filter(quotes, lambda q: (q != "") & F.contains(F.col("text"), q)))
    return F.try_divide(F.sum(good), F.sum(F.size(quotes)))


def confusion(df: DataFrame) -> DataFrame:
    """Dense 4 x 4: gold by predicted, zeros filled in."""
    gold = df.sparkSession.createDataFrame([(v,) for v in VERDICTS], "gold_verdict string")
    found = df.groupBy("gold_verdict").pivot("pred_verdict", list(VERDICTS)).count()
    return gold.join(found, "gold_verdict", "left").na.fill(0, list(VERDICTS))


def slices(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rollup per value of every key; null values have no slice."""
    pairs = F.array(*[F.struct(F.lit(k).alias("slice_key"), F.lower(F.col(k).cast("string")).alias("slice_value")) for k in keys])
    return df.withColumn("_s", F.explode(pairs)).filter("_s.slice_value is not null").groupBy("_s.slice_key", "_s.slice_value").agg(*rollup())


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Independent count tables of several keys in one pass; null and booleans in lower case."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.lower(F.col(k).cast("string")), F.lit("null")).alias("value")) for k in keys])
    return df.select(F.explode(pairs).alias("s")).groupBy("s.key", "s.value").agg(F.count("*").alias("n"))


# -- percentiles ----------------------------------------------------------------
def nearest_rank(value: str, q: float) -> Column:
    return F.expr(f"percentile_disc({q / 100}) within group (order by {value})")


def percentile_at(df: DataFrame, value: str, index: Column, by: list[str], name: str) -> DataFrame:
    """The value at a 0-based index that may depend on _n; equal values are counted before ranking."""
    return ordered.order_statistics(df, value, {name: index}, by)


# -- paired comparison and resampling --------------------------------------------
def paired(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Two systems' predictions side by side; a missing partner has nulls."""
    left = a.select(key, F.col("pred_verdict").alias("verdict_a"), F.col("pred_category").alias("category_a"))
    right = b.select(key, F.col("pred_verdict").alias("verdict_b"), F.col("pred_category").alias("category_b"))
    return left.join(right, key, "full")


def parity(pairs: DataFrame) -> DataFrame:
    """Agreement of verdicts, and of categories where both agree on a flagged verdict."""
    same = F.col("verdict_a") == F.col("verdict_b")
    flagged = same & F.col("verdict_a").isin(*FLAGGED)
    return pairs.agg(
        F.count("*").alias("n"), rate(F.coalesce(same, F.lit(False)), F.lit(True)).alias("verdict_agreement"), rate(F.col("category_a").eqNullSafe(F.col("category_b")), F.coalesce(flagged, F.lit(False))).alias("category_agreement"),
        F.count_if(~F.coalesce(same, F.lit(False))).alias("n_differ"), F.count_if(F.col("verdict_a").isNull() | F.col("verdict_b").isNull()).alias("n_unpaired"),
    )


def mcnemar(df: DataFrame, right_a: Column, right_b: Column) -> DataFrame:
    """b, c and the exact two-sided binomial p (1 where b + c is 0)."""
    n = df.agg(F.count_if(right_a & ~right_b).alias("b"), F.count_if(~right_a & right_b).alias("c"))
    total, low = F.col("b") + F.col("c"), F.least("b", "c")
    # log of C(n, k) / 2^n, built up term by term
    start = F.struct((-total * F.log(F.lit(2.0))).alias("t"), F.lit(0.0).alias("s"))
    step = lambda acc, k: F.struct((acc["t"] + F.log((total - k) / (k + 1))).alias("t"), (acc["s"] + F.exp(acc["t"])).alias("s"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), low), start, step)["s"]
    return n.withColumn("p", F.when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)))


def resample_index(seed: int, resample: Column, position: Column, n: Column) -> Column:
    """Row index that a resample draws at a position: the same hash in any engine with md5."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), resample, position))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % n


def bootstrap(df: DataFrame, key: str, n_resamples: int = 1000, seed: int = 0) -> DataFrame:
    """2.5 % and 97.5 % of every headline metric over resamples with replacement.

    All metrics share the resamples.  Rows get an index by key order: ranges of the key
    are sorted apart and numbered from the counts of the earlier ones, so no task takes
    all rows.  Draws are joined to the rows by index; nothing of the rows is collected.
    """
    ranges = materialise(df.repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "ranges")  # written, so that all steps see one division
    before = F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(ranges.groupBy("_p").count().select("_p", before.alias("_before")))  # a row per partition
    rows = ranges.join(starts, "_p").withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1).drop("_p", "_before")
    n = ranges.count()
    spark = df.sparkSession
    draws = spark.range(n_resamples * n).select(F.floor(F.col("id") / n).alias("resample"), (F.col("id") % n).alias("position"))
    picked = draws.select("resample", resample_index(seed, F.col("resample"), F.col("position"), F.lit(n)).alias("_i"))
    each = picked.join(rows, "_i").groupBy("resample").agg(*[f().alias(k) for k, f in HEADLINE.items()])
    return _intervals(each, n_resamples)


def _intervals(each: DataFrame, n_resamples: int) -> DataFrame:
    """Of a row of metrics per resample: the 2.5 % and 97.5 % of every metric that half of the resamples define."""
    long = each.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in HEADLINE])).alias("m")).select("m.*")
    found = long.groupBy("metric").agg(F.count("value").alias("n_defined"), F.expr("percentile(value, 0.025)").alias("low"), F.expr("percentile(value, 0.975)").alias("high"))  # n_resamples values a metric
    enough = F.col("n_defined") * 2 >= n_resamples
    return found.select("metric", "n_defined", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"))


#: Cells whose counts are sent to the tasks that resample.
MAX_CELLS = 200_000
_CELL = ["gold_verdict", "pred_verdict", "hard_negative", "category_right"]


def cells(df: DataFrame) -> DataFrame:
    """Rows counted by what the headline metrics see of them: as many rows as there are combinations, in one fixed order."""
    right = F.col("pred_category").eqNullSafe(F.col("gold_category")).alias("category_right")
    counted = df.select("gold_verdict", "pred_verdict", "hard_negative", right).groupBy(*_CELL).agg(F.count("*").alias("n"))
    return counted.orderBy(*_CELL)


def resampled_counts(spark, counts: list[int], n_resamples: int, seed: int = 0) -> DataFrame:
    """(resample, cell, n): how often each resample with replacement of sum(counts) rows draws a row of each cell.

    Multinomial, as conditional binomials: given what is left to draw, a cell gets
    Binomial(left, its share of the cells not drawn yet).  The numbers come from a
    counter-based generator keyed by (seed, resample), so a repeated task repeats them.
    """
    arrow_rows(spark)

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for resample in batch.column(0).to_pylist():
                draw = np.random.Generator(np.random.Philox(key=[seed, resample]))
                left, rest = sum(counts), sum(counts)
                for cell, c in enumerate(counts):
                    n = left if c == rest else int(draw.binomial(left, c / rest))
                    left, rest = left - n, rest - c
                    if n:
                        for column, v in zip(out, (resample, cell, n)):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["resample", "cell", "n"])

    return spark.range(n_resamples).mapInArrow(run, "resample long, cell long, n long")


def bootstrap_cells(df: DataFrame, n_resamples: int = 1000, seed: int = 0) -> DataFrame:
    """bootstrap() from cell counts: the same distribution of every metric, at cells x resamples in place of rows x resamples.

    All metrics share the resamples.  An empty table gives no rows, as no resample has any.
    """
    spark = df.sparkSession
    own = cells(df).limit(MAX_CELLS + 1).collect()  # combinations of closed vocabularies
    if len(own) > MAX_CELLS:
        raise ValueError("more cells than the metrics' vocabularies have")
    # a cell keeps what the metrics look at; categories are right or wrong
    named = [(i, *[r[c] for c in _CELL[:3]], "x", "x" if r.category_right else "y") for i, r in enumerate(own)]
    cell_rows = spark.createDataFrame(named, "cell long, gold_verdict string, pred_verdict string, hard_negative boolean, gold_category string, pred_category string")
    drawn = resampled_counts(spark, [r.n for r in own], n_resamples if own else 0, seed).join(F.broadcast(cell_rows), "cell")  # MAX_CELLS rows at most
    each = drawn.groupBy("resample").agg(*[f(weight=F.col("n")).alias(k) for k, f in HEADLINE.items()])
    return _intervals(each, n_resamples)


def verdicts_by_group(df: DataFrame) -> DataFrame:
    """Predictions of gold-SUSPICIOUS rows per seed group; the group is the given one or the id's stem."""
    group = F.coalesce("seed_group", F.regexp_replace(F.col("id").cast("string"), r"[-_](\d+|v\d+|s\d+)$", ""))
    return df.filter("gold_verdict = 'SUSPICIOUS'").groupBy(group.alias("seed_group"), "pred_verdict").count()


def best_runs(epochs: DataFrame) -> DataFrame:
    """Per digest the epoch of highest (macro_f1, recall), nulls as 0, the first of equals."""
    w = Window.partitionBy("digest").orderBy(F.desc(F.coalesce("macro_f1", F.lit(0.0))), F.desc(F.coalesce("recall", F.lit(0.0))), "run", "epoch")
    return epochs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def runs_by_digest(runs: DataFrame, current: str) -> DataFrame:
    """Per dev digest its runs in the order of their names and the best epoch; the current digest's row has the last ``place``."""
    named = runs.groupBy("digest").agg(F.sort_array(F.collect_set("run")).alias("runs"))  # one row a run, few runs a digest
    top = best_runs(runs).select("digest", F.col("run").alias("best_run"), F.col("epoch").alias("best_epoch"))
    rows = named.join(top, "digest").withColumn("is_current", F.col("digest") == current)
    return rows.withColumn("place", F.row_number().over(Window.orderBy("is_current", F.get("runs", F.lit(0)))))


def latency_summary(records: DataFrame) -> DataFrame:
    """p50, p95, max and n of the wall time, of every stage, and per verdict; failed rows are only counted."""
    good = records.filter(F.col("error").isNull())
    rows = (
        good.select(F.lit("wall").alias("part"), F.col("wall_ms").alias("ms"))
        .unionByName(good.select(F.explode("timings_ms").alias("part", "ms")))
        .unionByName(good.select(F.concat(F.lit("verdict:"), "verdict").alias("part"), F.col("wall_ms").alias("ms")))
    )
    return rows.groupBy("part").agg(nearest_rank("ms", 50).alias("p50"), nearest_rank("ms", 95).alias("p95"), F.max("ms").alias("max_ms"), F.count("ms").alias("n"))


def token_totals(df: DataFrame, length: str, most: int, price_per_million: float) -> DataFrame:
    cut = F.least(F.col(length), F.lit(most))
    return df.agg(F.sum(cut).alias("tokens"), F.count_if(F.col(length) > most).alias("truncated"), F.round(F.sum(cut) * price_per_million / 1e6, 4).alias("cost_usd"))


def billing_windows(events: DataFrame, since: str, until: str, days: int = 14) -> DataFrame:
    """Usage from ``since`` up to ``until``, per kind and page of ``days`` days (the last one may be short)."""
    inside = events.filter((F.col("at") >= F.lit(since).cast("timestamp")) & (F.col("at") < F.lit(until).cast("timestamp")))
    page = F.floor(F.timestamp_diff("SECOND", F.lit(since).cast("timestamp"), F.col("at")) / (86_400 * days)).alias("page")
    return inside.groupBy(page, "kind").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("rate") / 1e6).alias("usd"), F.sort_array(F.collect_set("rate")).alias("rates"), F.count_if(F.col("rate").isNull()).alias("unpriced"))


def billing(events: DataFrame) -> DataFrame:
    """Per kind of usage: tokens, dollars, the rates seen, events without a price."""
    return events.groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("rate") / 1e6).alias("usd"), F.sort_array(F.collect_set("rate")).alias("rates"), F.count_if(F.col("rate").isNull()).alias("unpriced"))
