"""Queries of the evaluation family: metrics, slices, comparison, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate, metrics, ordered
from .frames import EVAL, duck, view

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_E = f"e AS ({duck(EVAL)})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _eval(spark, sf):
    return view(spark, sf, EVAL, "labels")


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


_FLAG = "pred_verdict IN ('SCAM','SUSPICIOUS')"
_F1 = " + ".join(f"coalesce(2.0 * count(*) FILTER (gold_verdict = '{c}' AND pred_verdict = '{c}') / nullif(count(*) FILTER (gold_verdict = '{c}') + count(*) FILTER (pred_verdict = '{c}'), 0), 0)" for c in ("SCAM", "SUSPICIOUS", "SAFE"))
_N = " + ".join(f"CAST(count(*) FILTER (gold_verdict = '{c}' OR pred_verdict = '{c}') > 0 AS INT)" for c in ("SCAM", "SUSPICIOUS", "SAFE"))
_ROLLUP = f"""
round(count(*) FILTER (gold_verdict='SCAM' AND {_FLAG}) / nullif(count(*) FILTER (gold_verdict='SCAM'), 0), 6) AS scam_recall,
round(count(*) FILTER (gold_verdict='SCAM' AND pred_verdict='SCAM') / nullif(count(*) FILTER (gold_verdict='SCAM'), 0), 6) AS strict_scam_recall,
round(count(*) FILTER (gold_verdict='SAFE' AND {_FLAG}) / nullif(count(*) FILTER (gold_verdict='SAFE'), 0), 6) AS fpr_genuine,
round(count(*) FILTER (gold_verdict='SAFE' AND hard_negative AND {_FLAG}) / nullif(count(*) FILTER (gold_verdict='SAFE' AND hard_negative), 0), 6) AS fpr_hard_negative,
round(({_F1}) / nullif({_N}, 0), 6) AS macro_f1,
round(count(*) FILTER (gold_verdict='SCAM' AND pred_category IS NOT DISTINCT FROM gold_category) / nullif(count(*) FILTER (gold_verdict='SCAM'), 0), 6) AS category_accuracy,
round(count(*) FILTER (pred_verdict = 'UNKNOWN') / count(*), 6) AS unknown_rate,
count(*) AS n, count(*) FILTER (gold_verdict='SCAM') AS n_scam, count(*) FILTER (gold_verdict='SUSPICIOUS') AS n_suspicious, count(*) FILTER (gold_verdict='SAFE') AS n_genuine,
count(*) FILTER (gold_verdict='SAFE' AND hard_negative) AS n_hard_negative,
round(avg(CAST(json_valid AS INT)), 6) AS json_validity, round(avg(CAST(json_parsed AS INT)), 6) AS json_parse_rate, count(error) AS n_errors"""
_RATES = (*metrics.HEADLINE, "json_validity", "json_parse_rate")


@query(f"WITH {_E} SELECT {_ROLLUP} FROM e")
def metric_rollup(spark, sf):
    return rounded(_eval(spark, sf).agg(*metrics.rollup()), *_RATES)


_SLICE_KEYS = ["language", "gold_category", "obfuscated", "source", "source_phone"]
_UNPIVOT = " UNION ALL ".join(f"SELECT '{k}' AS slice_key, lower(CAST({k} AS VARCHAR)) AS slice_value, e.* FROM e WHERE {k} IS NOT NULL" for k in _SLICE_KEYS)


@query(f"WITH {_E}, s AS ({_UNPIVOT}) SELECT slice_key, slice_value, {_ROLLUP} FROM s GROUP BY slice_key, slice_value")
def slice_metrics(spark, sf):
    return rounded(metrics.slices(_eval(spark, sf), _SLICE_KEYS), *_RATES)


@query(
    f"WITH {_E}, c AS (SELECT unnest(['SCAM','SUSPICIOUS','SAFE']) AS class), t AS (SELECT class, count(*) FILTER (gold_verdict = class AND pred_verdict = class) AS tp, count(*) FILTER (gold_verdict <> class AND pred_verdict = class) AS fp, "
    "count(*) FILTER (gold_verdict = class AND pred_verdict <> class) AS fn FROM e, c GROUP BY class) SELECT class, tp, fp, fn, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM t WHERE tp + fp + fn > 0"
)
def per_class_f1(spark, sf):
    return rounded(metrics.per_class_f1(_eval(spark, sf)), "f1")


@query(f"WITH {_E}, v AS (SELECT unnest(['SCAM','SUSPICIOUS','SAFE','UNKNOWN']) AS gold_verdict) SELECT v.gold_verdict, " + ", ".join(f"count(*) FILTER (e.pred_verdict = '{c}') AS {c}" for c in ("SCAM", "SUSPICIOUS", "SAFE", "UNKNOWN")) + " FROM v LEFT JOIN e ON v.gold_verdict = e.gold_verdict GROUP BY v.gold_verdict")
def confusion_matrix(spark, sf):
    return metrics.confusion(_eval(spark, sf))


_COUNT_KEYS = ["gold_verdict", "gold_category", "language", "source", "obfuscated", "hard_negative", "source_phone"]


@query(f"WITH {_E}, s AS (" + " UNION ALL ".join(f"SELECT '{k}' AS key, coalesce(lower(CAST({k} AS VARCHAR)), 'null') AS value FROM e" for k in _COUNT_KEYS) + ") SELECT key, value, count(*) AS n FROM s GROUP BY key, value")
def multi_key_counts(spark, sf):
    return metrics.key_counts(_eval(spark, sf), _COUNT_KEYS)


def _pairs(spark, sf):
    e = _eval(spark, sf)
    return metrics.paired(e, e.select("id", F.col("pred_verdict_b").alias("pred_verdict"), F.col("pred_category_b").alias("pred_category")))


@query(
    f"WITH {_E} SELECT count(*) AS n, round(count(*) FILTER (pred_verdict = pred_verdict_b) / count(*), 6) AS verdict_agreement, round(count(*) FILTER (pred_verdict = pred_verdict_b AND {_FLAG} AND pred_category IS NOT DISTINCT FROM pred_category_b) / nullif(count(*) FILTER (pred_verdict = pred_verdict_b AND {_FLAG}), 0), 6) AS category_agreement, "
    "count(*) FILTER (pred_verdict <> pred_verdict_b) AS n_differ, CAST(0 AS BIGINT) AS n_unpaired FROM e"
)
def paired_parity(spark, sf):
    return rounded(metrics.parity(_pairs(spark, sf)), "verdict_agreement", "category_agreement")


@query(f"WITH {_E} SELECT id, pred_verdict AS verdict_a, pred_verdict_b AS verdict_b FROM e WHERE pred_verdict <> pred_verdict_b")
def paired_disagreements(spark, sf):
    return _pairs(spark, sf).filter("verdict_a <> verdict_b").select("id", "verdict_a", "verdict_b")


@query(
    f"WITH {_E}, n AS (SELECT count(*) FILTER (pred_verdict = gold_verdict AND pred_verdict_b <> gold_verdict) AS b, count(*) FILTER (pred_verdict <> gold_verdict AND pred_verdict_b = gold_verdict) AS c FROM e), "
    "k AS (SELECT b, c, unnest(range(0, least(b, c) + 1)) AS k FROM n) SELECT b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)))) END, 6) AS p FROM k GROUP BY b, c"
)
def mcnemar_exact(spark, sf):
    right = lambda c: F.col(c) == F.col("gold_verdict")
    return rounded(metrics.mcnemar(_eval(spark, sf), right("pred_verdict"), right("pred_verdict_b")), "p")


@query(f"WITH {_E}, o AS (SELECT latency_ms AS v, row_number() OVER (ORDER BY latency_ms) - 1 AS i, count(*) OVER () AS n FROM e) SELECT max(v) FILTER (i = least(n - 1, CAST(ceil(0.95 * n) AS BIGINT) - 1)) AS nearest_rank, max(v) FILTER (i = least(n - 1, CAST(floor(0.95 * n) AS BIGINT))) AS floor_index, max(v) FILTER (i = greatest(0, least(n - 1, CAST(round_even(0.95 * n + 0.5, 0) AS BIGINT) - 1))) AS rounded_rank FROM o")
def percentile_kinds(spark, sf):
    at = {"nearest_rank": ordered.nearest_rank(95), "floor_index": ordered.floor_index(0.95), "rounded_rank": ordered.rounded_rank(95)}
    return ordered.order_statistics(_eval(spark, sf), "latency_ms", at)  # one row


_CUT = "percentile_disc({q}) WITHIN GROUP (ORDER BY latency_ms)"


@query(
    f"WITH {_E}, g AS (SELECT * FROM e WHERE error IS NULL), r AS (SELECT 'wall' AS part, latency_ms AS ms FROM g UNION ALL SELECT 'rules', id % 20 FROM g UNION ALL SELECT 'detect', latency_ms * 3 // 4 FROM g UNION ALL SELECT concat('verdict:', pred_verdict), latency_ms FROM g) "
    "SELECT part, percentile_disc(0.5) WITHIN GROUP (ORDER BY ms) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY ms) AS p95, max(ms) AS max_ms, count(ms) AS n FROM r GROUP BY part"
)
def latency_summary(spark, sf):
    rows = _eval(spark, sf).select(F.col("latency_ms").alias("wall_ms"), F.expr("map('rules', id % 20, 'detect', latency_ms * 3 div 4)").alias("timings_ms"), F.col("pred_verdict").alias("verdict"), "error")
    return metrics.latency_summary(rows)


@query(f"WITH {_E} SELECT concat('g', CAST(id % 8 AS VARCHAR)) AS seed_group, pred_verdict, count(*) AS count FROM e WHERE gold_verdict = 'SUSPICIOUS' GROUP BY 1, 2")
def suspicious_by_group(spark, sf):
    return metrics.verdicts_by_group(_eval(spark, sf).withColumn("seed_group", F.expr("CASE WHEN id % 2 = 0 THEN concat('g', CAST(id % 8 AS STRING)) END")).withColumn("id", F.expr("concat('g', CAST(id % 8 AS STRING), '-', CAST(id AS STRING))")))


@query(
    f"WITH {_E}, m AS (SELECT concat('d', CAST(id % 3 AS VARCHAR)) AS digest, concat('r', CAST(id % 4 AS VARCHAR)) AS run, id % 5 AS epoch, round(count(*) FILTER (gold_verdict = pred_verdict) / count(*), 2) AS macro_f1, round(count(*) FILTER ({_FLAG}) / count(*), 2) AS recall FROM e GROUP BY 1, 2, 3), "
    "w AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY macro_f1 DESC, recall DESC, run, epoch) AS k FROM m) SELECT digest, run, epoch, macro_f1, recall FROM w WHERE k = 1"
)
def best_run(spark, sf):
    e = _eval(spark, sf)
    right = F.round(F.count_if(F.col("gold_verdict") == F.col("pred_verdict")) / F.count("*"), 2).alias("macro_f1")
    flagged = F.round(F.count_if(F.col("pred_verdict").isin("SCAM", "SUSPICIOUS")) / F.count("*"), 2).alias("recall")
    m = e.groupBy(F.expr("concat('d', CAST(id % 3 AS STRING))").alias("digest"), F.expr("concat('r', CAST(id % 4 AS STRING))").alias("run"), (F.col("id") % 5).alias("epoch")).agg(right, flagged)
    return metrics.best_runs(m)


_BOOT = 200
_HEADS = ("scam_recall", "strict_scam_recall", "fpr_genuine", "fpr_hard_negative", "macro_f1", "category_accuracy", "unknown_rate")


@query(
    f"WITH {_E}, r AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS total FROM e), d AS (SELECT b.b, CAST(('0x' || substr(md5('0|' || CAST(b.b AS VARCHAR) || '|' || CAST(p.i AS VARCHAR)), 1, 12)) AS BIGINT) % p.total AS i FROM range(0, {_BOOT}) b(b), r p), "
    f"x AS (SELECT d.b, {_ROLLUP.replace('round(', '(').replace(', 6)', ')')} FROM d JOIN r ON d.i = r.i GROUP BY d.b), l AS (UNPIVOT (SELECT b, {', '.join(_HEADS)} FROM x) ON {', '.join(_HEADS)} INTO NAME metric VALUE value) "
    "SELECT metric, count(value) AS n_defined, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM l GROUP BY metric"
)
def bootstrap_intervals(spark, sf):
    return rounded(metrics.bootstrap(_eval(spark, sf), "id", _BOOT), "low", "high")


@query()
def bootstrap_intervals_1000(spark, sf):
    """The production intervals of 1000 resamples; bootstrap_intervals is its twin of 200 that the SQL can follow."""
    return rounded(metrics.bootstrap(_eval(spark, sf), "id"), "low", "high")


@query()
def bootstrap_cells_1000(spark, sf):
    """The intervals of 1000 resamples drawn as cell counts: another draw of the same distribution, without a row per draw."""
    return rounded(metrics.bootstrap_cells(_eval(spark, sf)), "low", "high")


# -- spans and grounding: quotes are stretches of the message's own words ---------------
_QUOTED = """SELECT e.id, d.text, e.gold_verdict, e.pred_verdict,
  CASE WHEN e.gold_verdict = 'SAFE' THEN '' ELSE substr(d.text, 1, 40) END AS gq, CASE WHEN e.pred_verdict = 'UNKNOWN' THEN '' WHEN e.id % 4 = 0 THEN concat(substr(d.text, 11, 40), '#') ELSE substr(d.text, 11, 40) END AS pq
  FROM ({e}) e JOIN documents d ON e.id = d.doc_id"""


def _quoted(spark, sf):
    rows = view(spark, sf, _QUOTED.format(e=EVAL), "labels", "documents")
    array = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.array(c))
    return rows.withColumn("gold_quotes", array("gq")).withColumn("pred_quotes", array("pq"))


_TOK = r"regexp_extract_all(lower({q}), '[\p{{L}}\p{{N}}_]+')"


@query(
    f"WITH q AS ({_QUOTED.format(e=duck(EVAL))}), t AS (SELECT id, unnest({_TOK.format(q='gq')}) AS token, 1 AS g, 0 AS p FROM q WHERE gq <> '' UNION ALL SELECT id, unnest({_TOK.format(q='pq')}), 0, 1 FROM q WHERE gq <> ''), s AS (SELECT id, token, sum(g) AS g, sum(p) AS p FROM t GROUP BY id, token), "
    "x AS (SELECT sum(least(g, p)) AS m, sum(g) AS gold, sum(p) AS pred FROM s) SELECT round(m / pred, 6) AS precision, round(m / gold, 6) AS recall, round(2 * m / (pred + gold), 6) AS span_f1 FROM x"
)
def span_f1(spark, sf):
    return rounded(metrics.span_f1(_quoted(spark, sf)), "precision", "recall", "span_f1")


@query(f"WITH q AS ({_QUOTED.format(e=duck(EVAL))}) SELECT round(count(*) FILTER (pq <> '' AND contains(text, pq)) / nullif(count(*) FILTER (pq <> ''), 0), 6) AS grounding_rate FROM q")
def grounding_rate(spark, sf):
    return _quoted(spark, sf).agg(F.round(metrics.grounding_rate(), 6).alias("grounding_rate"))


# -- calibration ---------------------------------------------------------------------
_CASES = "SELECT gold_verdict AS label, CASE WHEN id % 19 = 0 THEN NULL ELSE (CASE WHEN gold_verdict = 'SCAM' THEN 400 + score * 6 // 10 WHEN gold_verdict = 'SAFE' THEN score * 6 // 10 ELSE score END) END AS s, id % 31 = 0 AS hard, id % 23 = 0 AS soft FROM ({e})"


def _cases(spark, sf):
    e = view(spark, sf, _CASES.format(e=EVAL).replace("//", "div"), "labels")
    some = lambda c, n: F.when(F.col(c), F.array(F.lit(n))).otherwise(F.array().cast("array<string>"))
    return e.select("label", (F.col("s") / 1000).alias("p_scam"), (1 - F.col("s") / 1000).alias("p_safe"), some("hard", "apk_link").alias("hard"), some("soft", "threat_lexicon").alias("soft"))


_C = f"c AS ({_CASES.format(e=duck(EVAL))})"


@query(
    f"WITH {_C}, k AS (SELECT DISTINCT s / 1000.0 AS t FROM c WHERE s IS NOT NULL UNION SELECT 1.0), w AS (SELECT k.t, coalesce(lag(k.t) OVER (ORDER BY k.t), 0) AS before, (SELECT count(*) FROM c WHERE label = 'SCAM' AND (hard OR s / 1000.0 >= k.t)) AS hits, (SELECT count(*) FROM c WHERE label = 'SAFE' AND (hard OR s / 1000.0 >= k.t)) AS misses FROM k), "
    "e AS (SELECT t, before, hits FROM w WHERE misses <= 0.2 * (SELECT count(*) FROM c WHERE label = 'SAFE') ORDER BY t LIMIT 1), r AS (SELECT max(w.t) AS top FROM w, e WHERE w.t >= e.t AND w.hits = e.hits) "
    "SELECT round(e.t, 6) AS edge, round(e.before, 6) AS low, round(top, 6) AS high, round((e.before + top) / 2, 6) AS value, true AS feasible FROM e, r"
)
def threshold_high(spark, sf):
    return rounded(calibrate.t_high(_cases(spark, sf), 0.2), "edge", "low", "high", "value")


@query(
    f"WITH {_C}, k AS (SELECT DISTINCT s / 1000.0 AS t FROM c WHERE s IS NOT NULL), f AS (SELECT label, s / 1000.0 AS p, hard OR coalesce(s / 1000.0 >= 0.9, false) OR (s IS NULL AND soft) AS forced FROM c), "
    "w AS (SELECT k.t, coalesce(lag(k.t) OVER (ORDER BY k.t), 0) AS before, (SELECT count(*) FROM f WHERE label <> 'SAFE' AND (forced OR p >= k.t)) AS hits, (SELECT count(*) FROM f WHERE label = 'SAFE' AND (forced OR p >= k.t)) AS misses FROM k), "
    "e AS (SELECT t, misses FROM w WHERE hits >= 0.9 * (SELECT count(*) FROM c WHERE label <> 'SAFE') ORDER BY t DESC LIMIT 1), r AS (SELECT min(w.before) AS low FROM w, e WHERE w.t <= e.t AND w.misses = e.misses) "
    "SELECT round(e.t, 6) AS edge, round(low, 6) AS low, round(e.t, 6) AS high, round((low + e.t) / 2, 6) AS uncapped, round(least((low + e.t) / 2, 0.5), 6) AS value, true AS feasible FROM e, r"
)
def threshold_low(spark, sf):
    return rounded(calibrate.t_low(_cases(spark, sf), 0.9, 0.9), "edge", "low", "high", "uncapped", "value")


@query(f"WITH {_E} SELECT CAST(sum(least(latency_ms, 512)) AS BIGINT) AS tokens, count(*) FILTER (latency_ms > 512) AS truncated, round(sum(least(latency_ms, 512)) * 0.2 / 1e6, 4) AS cost_usd FROM e")
def token_totals(spark, sf):
    return metrics.token_totals(_eval(spark, sf), "latency_ms", 512, 0.2)


@query(f"WITH {_E} SELECT language AS kind, CAST(sum(latency_ms) AS BIGINT) AS tokens, round(sum(latency_ms * (1 + id % 3) / 1e6) FILTER (id % 7 <> 0), 6) AS usd, count(*) FILTER (id % 7 = 0) AS unpriced FROM e GROUP BY language")
def billing_rollup(spark, sf):
    rows = _eval(spark, sf).select(F.col("language").alias("kind"), F.col("latency_ms").alias("tokens"), F.expr("CASE WHEN id % 7 <> 0 THEN CAST(1 + id % 3 AS DOUBLE) END").alias("rate"))
    return rounded(metrics.billing(rows).drop("rates"), "usd")
