import pytest
from pyspark.sql import functions as F

from tidewarden.operators import calibrate, metrics

ROWS = [("SCAM", "SCAM", "a", "a", False, True), ("SCAM", "SUSPICIOUS", "a", "b", False, True), ("SCAM", "SAFE", "a", None, False, False), ("SAFE", "SUSPICIOUS", "g", None, True, True), ("SAFE", "SAFE", "g", "g", False, True), ("SUSPICIOUS", "UNKNOWN", "a", None, False, None)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, *r, None, None) for i, r in enumerate(ROWS)], "id int, gold_verdict string, pred_verdict string, gold_category string, pred_category string, hard_negative boolean, json_valid boolean, json_parsed boolean, error string")


def test_six_rows(frame):
    r = frame.agg(*metrics.rollup()).first()
    assert r.scam_recall == pytest.approx(2 / 3) and r.strict_scam_recall == pytest.approx(1 / 3) and r.fpr_genuine == 0.5 and r.fpr_hard_negative == 1.0
    assert r.macro_f1 == pytest.approx(1 / 3) and r.category_accuracy == pytest.approx(1 / 3) and r.json_validity == pytest.approx(4 / 5) and r.unknown_rate == pytest.approx(1 / 6) and r.n_errors == 0


def test_empty_is_null(frame):
    r = frame.filter("false").agg(*metrics.rollup()).first()
    assert r.scam_recall is None and r.macro_f1 is None and r.json_validity is None and r.n == 0


def test_span_f1(spark):
    df = spark.createDataFrame([(1, ["a b b c", "d e f g h i"], ["a b c", "d e x"]), (2, [], ["z"])], "id int, gold_quotes array<string>, pred_quotes array<string>")
    r = metrics.span_f1(df).first()
    assert r.precision == pytest.approx(5 / 6) and r.recall == pytest.approx(5 / 10)
    assert metrics.span_f1(df.filter("id = 2")).first().span_f1 is None


def test_percentiles(spark):
    df = spark.range(1, 21).select(F.col("id").alias("v"))
    assert df.agg(metrics.nearest_rank("v", 95).alias("p")).first().p == 19
    assert metrics.percentile_at(df, "v", metrics.floor_index(0.95), [], "p").first().p == 20
    assert metrics.percentile_at(df, "v", metrics.rounded_rank(95), [], "p").first().p == 20
    assert metrics.percentile_at(df.filter("false"), "v", metrics.floor_index(0.95), [], "p").count() == 0


def test_mcnemar(spark):
    df = spark.createDataFrame([(True, False)] * 10 + [(False, True)] * 2 + [(True, True)] * 5, "a boolean, b boolean")
    assert metrics.mcnemar(df, F.col("a"), F.col("b")).first().p == pytest.approx(0.0386, abs=1e-4)
    assert metrics.mcnemar(df.filter("a and b"), F.col("a"), F.col("b")).first().p == 1.0


def _cases(spark, rows):
    return spark.createDataFrame([(label, p, 1 - p if p is not None else None, ["x"] if h else [], []) for label, p, h in rows], "label string, p_scam double, p_safe double, hard array<string>, soft array<string>")


def test_threshold_separable(spark):
    rows = [("SCAM", p, False) for p in (0.90, 0.92, 0.95, 0.97, 0.99)] + [("SAFE", p, False) for p in (0.01, 0.02, 0.05, 0.10, 0.20)]
    r = calibrate.t_high(_cases(spark, rows)).first()
    assert (r.edge, r.low, r.high) == (0.9, 0.2, 0.9) and r.value == pytest.approx(0.55) and r.feasible
    low = calibrate.t_low(_cases(spark, rows), 0.55).first()
    assert low.value == 0.5


def test_threshold_three_percent(spark):
    make = lambda n: _cases(spark, [("SAFE", 0.0, False)] * (100 - n) + [("SAFE", 0.9, False)] * n + [("SCAM", 0.95, False)] * 10)
    r = calibrate.t_high(make(3)).first()
    assert r.edge == 0.9 and r.value == pytest.approx(0.475)
    r = calibrate.t_high(make(4)).first()
    assert r.edge == 0.95 and r.value == pytest.approx(0.925)


def test_threshold_infeasible_and_unknown(spark):
    r = calibrate.t_high(_cases(spark, [("SAFE", 0.1, i % 2 == 0) for i in range(10)] + [("SCAM", 0.9, False)])).first()
    assert r.value == 1.0 and not r.feasible
    assert calibrate.t_high(_cases(spark, [("SCAM", 0.9, False)])).first().value is None


def test_registered_bootstrap_of_1000(spark, tmp_path):
    import hashlib
    import math

    from tidewarden.plans import registry
    from tidewarden.plans.evaluation import _eval

    spark.createDataFrame([(i, int(i % 4 > 0), int(i % 7 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = _eval(spark, str(tmp_path)).orderBy("id").collect()
    values = {"scam_recall": [], "unknown_rate": []}
    for b in range(1000):
        drawn = [rows[int(hashlib.md5(f"0|{b}|{i}".encode()).hexdigest()[:12], 16) % len(rows)] for i in range(len(rows))]
        scam = [r for r in drawn if r.gold_verdict == "SCAM"]
        values["unknown_rate"].append(sum(r.pred_verdict == "UNKNOWN" for r in drawn) / len(drawn))
        if scam:
            values["scam_recall"].append(sum(r.pred_verdict in ("SCAM", "SUSPICIOUS") for r in scam) / len(scam))

    def cut(xs, q):
        xs, at = sorted(xs), q * (len(xs) - 1)
        low = math.floor(at)
        return xs[low] + (xs[min(low + 1, len(xs) - 1)] - xs[low]) * (at - low)

    got = {r.metric: r for r in registry.QUERIES["bootstrap_intervals_1000"](spark, str(tmp_path)).collect()}
    for k, xs in values.items():
        assert got[k].n_defined == len(xs)
        assert got[k].low == pytest.approx(cut(xs, 0.025), abs=1e-6) and got[k].high == pytest.approx(cut(xs, 0.975), abs=1e-6)
