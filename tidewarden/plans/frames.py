"""Frames the queries run on: the engine's entities derived from the driver's tables.

Each is one SQL text that Spark and DuckDB both read, so the two engines start from
the same rows.  Integer arithmetic on ids stands in for model output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SCAM = "'digital_arrest','kyc_account_block','malicious_apk','electricity_disconnect','courier_parcel','family_emergency','task_job_offer','investment_tips','lottery_prize','upi_collect_refund','otp_phishing','other_scam'"
_SAFE = "'genuine_otp','transaction_alert','delivery_update','legit_promo','govt_genuine','personal'"


def _nth(items: str, index: str) -> str:
    parts = items.split(",")
    return "CASE " + " ".join(f"WHEN ({index}) = {i} THEN {p}" for i, p in enumerate(parts)) + " END"


_GOLD = "CASE WHEN toxic = 1 THEN 'SCAM' WHEN quality = 1 AND doc_id % 5 <> 0 THEN 'SAFE' ELSE 'SUSPICIOUS' END"


def _pred(h: str) -> str:
    return f"CASE WHEN {h} < 60 THEN gold_verdict WHEN {h} < 75 THEN 'SUSPICIOUS' WHEN {h} < 90 THEN 'SAFE' WHEN {h} < 97 THEN 'SCAM' ELSE 'UNKNOWN' END"


EVAL = f"""
WITH gold AS (SELECT doc_id, {_GOLD} AS gold_verdict FROM labels),
named AS (SELECT doc_id AS id, gold_verdict,
  CASE WHEN gold_verdict = 'SAFE' THEN {_nth(_SAFE, 'doc_id % 6')} ELSE {_nth(_SCAM, 'doc_id % 12')} END AS gold_category,
  {_pred('(doc_id * 7919 + 13) % 100')} AS pred_verdict,
  {_pred('(doc_id * 6101 + 57) % 100')} AS pred_verdict_b
  FROM gold)
SELECT id, gold_verdict, gold_category, pred_verdict, pred_verdict_b,
  CASE WHEN pred_verdict = 'UNKNOWN' THEN NULL WHEN id % 7 < 5 THEN gold_category ELSE 'other_scam' END AS pred_category,
  CASE WHEN pred_verdict_b = 'UNKNOWN' THEN NULL WHEN id % 9 < 7 THEN gold_category ELSE 'other_scam' END AS pred_category_b,
  (gold_verdict = 'SAFE' AND gold_category IN ('genuine_otp', 'transaction_alert')) AS hard_negative,
  CASE WHEN id % 13 = 0 THEN NULL ELSE (id % 11 <> 0) END AS json_valid,
  CASE WHEN id % 13 = 0 THEN NULL ELSE (id % 17 <> 0) END AS json_parsed,
  CASE WHEN id % 41 = 0 THEN 'Timeout' ELSE NULL END AS error,
  CASE WHEN id % 3 = 0 THEN 'en' WHEN id % 3 = 1 THEN 'hi' ELSE 'hinglish' END AS language,
  (id % 6 = 0) AS obfuscated,
  CASE WHEN id % 4 = 0 THEN 'real' ELSE 'synthetic' END AS source,
  CASE WHEN id % 10 = 0 THEN NULL ELSE concat('phone', CAST(id % 3 AS STRING)) END AS source_phone,
  (id * 104729 + 17) % 1000 AS score,
  (id * 31) % 997 AS latency_ms
FROM named"""

#: Messages: one per labelled document, with its text.
ITEMS = f"""
SELECT e.id, d.text, e.gold_verdict AS verdict, e.gold_category AS category, e.language, e.obfuscated, e.hard_negative, e.source, d.source AS seed_group,
  CASE WHEN e.id % 4 = 0 THEN 'sms' WHEN e.id % 4 = 1 THEN 'whatsapp' WHEN e.id % 4 = 2 THEN 'call_description' ELSE 'screenshot' END AS channel,
  CASE WHEN e.id % 3 = 0 THEN 'VK-BANKAB' WHEN e.id % 3 = 1 THEN '+14155550100' ELSE NULL END AS sender
FROM ({EVAL}) e JOIN documents d ON e.id = d.doc_id"""

_KIND = "CASE WHEN event_type = 'error' THEN 'SCAM' WHEN event_type = 'purchase' THEN 'SUSPICIOUS' WHEN event_type = 'view' THEN 'SAFE' WHEN event_type = 'click' THEN 'ODD' ELSE NULL END"
#: Event store: events, verdicts (all but sign-ups) and feedback (every third).
STORE_EVENTS = "SELECT event_id AS id, concat('p', CAST(user_id % 7 AS STRING)) AS parent_id, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN 'sms' ELSE 'whatsapp' END AS channel, props AS text FROM events"
STORE_VERDICTS = f"SELECT event_id, {_KIND} AS verdict, event_type AS category, (event_id * 37) % 1000 / 1000.0 AS p_scam, (event_id * 53) % 4000 AS wall_ms, (event_id * 7) % 50 AS rules_ms, CASE WHEN event_id % 5 = 0 THEN (event_id * 11) % 900 ELSE 0 END AS perceive_ms FROM events WHERE event_type <> 'signup'"
STORE_FEEDBACK = "SELECT event_id, event_id % 2 = 0 AS correct FROM events WHERE event_id % 3 = 0"


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run one of the texts over Parquet tables without registering views: table names become relations."""
    return spark.sql(_bind(sql, tables), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def _bind(sql: str, tables) -> str:
    import re

    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return sql


def duck(sql: str) -> str:
    return sql.replace("AS STRING", "AS VARCHAR")
