import math

import pytest
from pyspark.sql import functions as F

from tidewarden.functions import text as T
from tidewarden.functions.vocab import BUILT_IN, read_dictionary
from tidewarden.operators import rules

CASES = [
    ("apk_link", "get http://evil.xyz/app.apk now", None, True), ("apk_link", "file update.apk", None, True), ("apk_link", "download from https://evil.xyz/x", None, True), ("apk_link", "download from https://northbank.com/x", None, False), ("apk_link", "hello", None, False),
    ("lookalike_domain", "https://northbamk.com/login", None, True), ("lookalike_domain", "https://northbank-help.xyz", None, True), ("lookalike_domain", "https://nörthbank.com", None, True), ("lookalike_domain", "https://secure.northbank.com", None, False), ("lookalike_domain", "https://weather.org", None, False),
    ("upi_pin_to_receive", "Enter your PIN to receive money", None, True), ("upi_pin_to_receive", "approve the request for your refund", None, True), ("upi_pin_to_receive", "never enter your pin to receive money", None, False), ("upi_pin_to_receive", "enter your pin. You receive nothing", None, False),
    ("unregistered_sender", "your bank account", "+919876543210", True), ("unregistered_sender", "your bank account", "AX-NORTHB", False), ("unregistered_sender", "hello", "+919876543210", False),
    ("shortener_link", "see bit.ly/abc", None, True), ("shortener_link", "see https://www.tinyurl.com/abc", None, True), ("shortener_link", "see north.com", None, False),
    ("threat_lexicon", "you will be ARRESTED", None, True), ("threat_lexicon", "गिरफ्तार होंगे", None, True), ("threat_lexicon", "a jailer", None, False),
    ("urgency_plus_payment", "pay now, urgent", None, True), ("urgency_plus_payment", "urgent news", None, False),
    ("foreign_code_authority", "police here, call +44 20 7946 0958", None, True), ("foreign_code_authority", "police here", "+1 415 555 0100", True), ("foreign_code_authority", "police here", "+919876543210", False),
    ("asks_otp_or_pin", "share the OTP with me", None, True), ("asks_otp_or_pin", "OTP bhej do na", None, True), ("asks_otp_or_pin", "do not share the OTP", None, False), ("asks_otp_or_pin", "your OTP is 1234. share the joy", None, False), ("asks_otp_or_pin", "do not wait, share the OTP", None, True),
]


def test_signals(spark):
    rows = spark.createDataFrame([(i, t, s) for i, (_, t, s, _) in enumerate(CASES)], "i int, text string, sender string")
    got = rows.select("i", T.normalize_message(F.col("text"), F.col("sender")).alias("n")).select("i", "n.text", rules.Rules().evaluate(F.col("n")).alias("s"))
    for r in got.collect():
        name, _, _, want = CASES[r.i]
        assert (name in r.s.evidence) == want, CASES[r.i]
        for quotes in r.s.evidence.values():
            assert all(q in r.text for q in quotes)
        assert {*r.s.hard, *r.s.soft} == {*r.s.evidence}


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "lexicon").mkdir()
    (tmp_path / "lexicon" / "a.txt").write_text("# note\n[threat]\nbad  thing\n\n[urgency]\nsoon*\n# [not]\n[threat]\nworse\n", "utf-8")
    (tmp_path / "lexicon" / "b.txt").write_text("[threat]\nｗｏｒｓｔ\n", "utf-8")
    (tmp_path / "official_domains.txt").write_text("Own.com # ours\n*.gov.in\n", "utf-8")
    (tmp_path / "brand_tokens.txt").write_text("own\n", "utf-8")
    (tmp_path / "shorteners.txt").write_text("", "utf-8")
    d = read_dictionary(spark, f"file://{tmp_path}")
    assert d.phrases == {"threat": ("bad thing", "worse", "worst"), "urgency": ("soon*",)} and (d.sites, d.zones, d.brands, d.short_hosts) == (("own.com",), ("gov.in",), ("own",), ())
    assert BUILT_IN.phrases["negation"]


@pytest.mark.parametrize(
    "hard, soft, p, q, want",
    [(1, 0, 0.0, 1.0, "SCAM"), (0, 0, None, None, "UNKNOWN"), (0, 1, None, None, "SUSPICIOUS"), (1, 0, None, None, "SCAM"), (0, 0, 0.8, 0.1, "SCAM"), (0, 0, 0.1, 0.6, "SUSPICIOUS"), (0, 2, 0.0, 1.0, "SUSPICIOUS"), (0, 1, 0.0, 1.0, "SAFE"), (0, 0, 0.4, None, "SUSPICIOUS")],
)
def test_fusion(spark, hard, soft, p, q, want):
    row = spark.createDataFrame([(["x"] * hard, ["x"] * soft, p, q)], "h array<string>, s array<string>, p double, q double")
    assert row.select(rules.fuse(F.col("h"), F.col("s"), F.col("p"), F.col("q")).alias("v")).first()["v"] == want


def _walk(spark, tokens):
    kind = "t array<struct<token: string, logprob: double, top: array<struct<token: string, logprob: double>>>>"
    rows = [[(a, math.log(p), [(x, math.log(y)) for x, y in top]) for a, p, top in tokens]]
    return spark.createDataFrame([(rows[0],)], kind).select(rules.label_probabilities(F.col("t")).alias("r")).first()["r"]


def test_label_probability(spark):
    whole = _walk(spark, [('{"verdict": "', 1.0, []), ("SCAM", 0.32, [("SCAM", 0.32), ("SAFE", 0.24), ("SUSPICIOUS", 0.08), ("odd", 0.2)]), ('"}', 1.0, [])])
    assert abs(whole.p_scam - 0.32 / 0.64) < 1e-9
    shared = _walk(spark, [('{"verdict": "', 1.0, []), ("S", 0.9, [("S", 0.9), ("SC", 0.05), ("SA", 0.03)]), ("CAM", 0.6, [("CAM", 0.6), ("U", 0.3), ("AFE", 0.1)]), ('"}', 1.0, [])])
    assert abs(shared.p_scam - 0.59 / 0.98) < 1e-9 and abs(shared.p_safe - 0.12 / 0.98) < 1e-9 and abs(shared.p_suspicious - 0.27 / 0.98) < 1e-9
    assert _walk(spark, [("no json", 1.0, [])]) is None
