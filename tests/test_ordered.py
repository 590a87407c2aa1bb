"""Running sums, order statistics and resampled cells against brute force and exact probabilities."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewarden.operators import metrics, ordered


def test_running_sums(spark):
    rnd = random.Random(1)
    rows = sorted({(rnd.choice("ab") if rnd.random() < 0.9 else None, v): (rnd.randint(0, 9), rnd.randint(0, 9)) for v in rnd.sample(range(10_000), 700)}.items(), key=str)
    df = spark.createDataFrame([(g, v, x, y) for (g, v), (x, y) in rows], "g string, v int, x long, y long").repartition(7)
    for by in ([], ["g"]):
        got = ordered.running(df, "v", ["x", "y"], by).collect()
        assert len(got) == len(rows)
        for r in got:
            mine = [(v, x, y) for (g, v), (x, y) in rows if not by or g == r.g]
            assert (r._to_x, r._to_y) == tuple(sum(m[k] for m in mine if m[0] <= r.v) for k in (1, 2))
            assert (r._all_x, r._all_y) == tuple(sum(m[k] for m in mine) for k in (1, 2))
            assert r._before == max((m[0] for m in mine if m[0] < r.v), default=None)


def test_order_statistics_of_groups(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, rnd.randint(0, 30), rnd.randint(0, 30)])) for _ in range(900)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    at = {"low": ordered.nearest_rank(5), "mid": ordered.floor_index(0.5), "high": ordered.rounded_rank(95)}
    got = {r.g: (r.low, r.mid, r.high) for r in ordered.order_statistics(df, "v", at, ["g"]).collect()}
    assert set(got) == {"a", "b", None}
    for g, found in got.items():
        v = sorted(x for k, x in rows if k == g and x is not None)
        n = len(v)
        assert found == (v[max(0, math.ceil(0.05 * n) - 1)], v[min(n - 1, int(0.5 * n))], v[max(0, min(n - 1, round(0.95 * n + 0.5) - 1))])
    assert ordered.order_statistics(df.filter("v is null"), "v", at).count() == 0


def test_resampled_counts_have_the_exact_distribution(spark):
    """Of 6 rows in cells of 1, 2 and 3: every outcome's share against its multinomial probability."""
    n = 20_000
    outcomes = Counter()
    each: dict[int, list[int]] = {}
    for r in metrics.resampled_counts(spark, [1, 2, 3], n).collect():
        each.setdefault(r.resample, [0, 0, 0])[r.cell] = r.n
    assert len(each) == n
    outcomes.update(map(tuple, each.values()))
    odd = 0.0
    for a in range(7):
        for b in range(7 - a):
            c = 6 - a - b
            p = math.factorial(6) / (math.factorial(a) * math.factorial(b) * math.factorial(c)) * (1 / 6) ** a * (2 / 6) ** b * (3 / 6) ** c
            odd += (outcomes[(a, b, c)] - n * p) ** 2 / (n * p)
    assert odd < 60  # chi-square of 27 degrees: 55.5 at 0.1 %
    again = {(r.resample, r.cell, r.n) for r in metrics.resampled_counts(spark, [1, 2, 3], 50).repartition(3).collect()}
    assert again == {(i, k, v) for i, own in each.items() if i < 50 for k, v in enumerate(own) if v}


def test_cell_bootstrap_agrees_with_row_bootstrap(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["SCAM", "SAFE", "SUSPICIOUS"]), rnd.choice(["SCAM", "SAFE", "UNKNOWN", None]), "a", rnd.choice(["a", "b", None]), rnd.random() < 0.3) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, gold_verdict string, pred_verdict string, gold_category string, pred_category string, hard_negative boolean")
    by_rows, by_cells = ({r.metric: r for r in f.collect()} for f in (metrics.bootstrap(df, "id", 400), metrics.bootstrap_cells(df, 4000)))
    assert set(by_rows) == set(by_cells) == set(metrics.HEADLINE)
    for k, r in by_cells.items():
        assert r.low == pytest.approx(by_rows[k].low, abs=0.06) and r.high == pytest.approx(by_rows[k].high, abs=0.06)
    weighted = metrics.cells(df).selectExpr("*", "'x' AS gold_category", "if(category_right, 'x', 'y') AS pred_category")
    whole, again = df.agg(*[f().alias(k) for k, f in metrics.HEADLINE.items()]).first(), weighted.agg(*[f(weight=F.col("n")).alias(k) for k, f in metrics.HEADLINE.items()]).first()
    assert whole == again
    assert metrics.bootstrap_cells(df.filter("false")).filter("n_defined > 0").count() == 0
