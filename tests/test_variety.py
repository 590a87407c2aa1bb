"""Rules of few-shot picks, rates, variation, doubts and filters, on own cases."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from tidewarden.functions import text as T
from tidewarden.operators import messages, rules, split, variety

ITEM = "id int, text string, verdict string, category string, language string, channel string, sender string, obfuscated boolean, hard_negative boolean, red_flags array<struct<quote: string, reason: string>>"


def item(i, text="plain words here", verdict="SCAM", category="other_scam", language="en", channel="sms", sender=None, obfuscated=False, hard=False, flags=None):
    return (i, text, verdict, category, language, channel, sender, obfuscated, hard, [(text[:5], "secrecy_request")] if flags is None and verdict != "SAFE" else flags or [])


def test_fewshot_follows_the_prompt(spark):
    rows = [item(i, category="a", language="en") for i in range(5)] + [item(10, category="b", language="en"), item(11, category="b", language="hi", obfuscated=True), item(12, category="c", language="hi", text="x" * 500)]
    rows += [item(20 + i, verdict="SAFE", category="genuine_otp", hard=True) for i in range(3)] + [item(30, verdict="SAFE", category="transaction_alert", hard=True, obfuscated=True)]
    rows += [item(40, verdict="SUSPICIOUS", category="a"), item(41, verdict="SAFE", category="personal", hard=True), item(42, verdict="SAFE", category="personal"), item(43, verdict="SAFE", category="personal", text="y" * 401)]
    for seed in range(6):
        got = {r.position: r for r in variety.fewshot(spark.createDataFrame(rows, ITEM), seed).collect()}
        assert [got[i].kind for i in range(1, 7)] == list(variety.FEWSHOT_ORDER) and len({r.id for r in got.values()}) == 6
        assert not got[1].obfuscated and len(got[1].text) <= 400
        assert got[1].category != got[4].category
        if got[1].language == "en" and got[1].category == "a":
            assert got[4].language == "hi"  # another language goes before plainness
        assert {got[2].category, got[6].category} == {"genuine_otp", "transaction_alert"} and got[5].id in (41, 42)


def test_fewshot_without_a_kind_is_an_error(spark):
    rows = [item(1), item(2, category="b"), item(3, verdict="SAFE", category="genuine_otp", hard=True), item(5, verdict="SUSPICIOUS")]
    with pytest.raises(ValueError, match="hard_negative.*safe_personal"):
        variety.fewshot(spark.createDataFrame(rows, ITEM))


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Ref No: 12", {"ref", "any"}), ("see reference", {"ref", "any"}), ("prefer", set()), ("references", set()), ("Order ID 5", {"order", "any"}), ("order ids", {"any"}), ("awb 1", {"order", "any"}), ("Consumer No. 4", {"case", "any"}),
        ("txn ids", {"payment", "any"}), ("UPI Ref No", {"payment", "ref", "any"}), ("A/c XX12", {"account", "any"}), ("a/c xxy", set()), ("संदर्भ संख्या: 1", {"hindi", "any"}), ("संदर्भ में", {"any"}), ("réf élan", set()), ("", set()),
    ],
)
def test_id_families(spark, text, kinds):
    row = spark.createDataFrame([(text,)], "text string").select(*[c.alias(k) for k, c in variety.id_families(F.col("text")).items()]).first()
    assert {k for k, v in row.asDict().items() if v} == kinds


def test_rates_make_ids_equally_frequent(spark):
    rows = [item(i, "Ref No 1" if i < 30 else "words", category="a", language="hi" if i % 2 else "en") for i in range(100)]
    rows += [item(1000 + i, "संदर्भ संख्या 1" if i < 10 else "words", "SAFE", "genuine_otp", "hi") for i in range(100)]
    rows += [item(2000 + i, "words", "SUSPICIOUS", "personal" if i < 80 else "a") for i in range(100)]
    got = {r.verdict: r for r in variety.reference_rates(spark.createDataFrame(rows, ITEM)).collect()}
    assert got["SCAM"].rate == pytest.approx(10 / 70) and got["SAFE"].rate == pytest.approx(30 / 90) and got["SUSPICIOUS"].rate == 1.0
    assert got["SCAM"].hindi_rate == 1.0 and got["SAFE"].hindi_rate == 0.0 and got["SUSPICIOUS"].hindi_rate == 0.0
    assert got["SUSPICIOUS"].eligible == pytest.approx(0.2)


@pytest.fixture(scope="module")
def varied(spark):
    kinds = [("SCAM", "other_scam"), ("SUSPICIOUS", "other_scam"), ("SAFE", "personal"), ("SAFE", "delivery_update"), ("SAFE", "legit_promo"), ("SAFE", "genuine_otp")]
    given = [item(i, "Keep it quiet till noon", *kinds[i % 6], language=("en", "hi")[i % 5 == 0], channel=("sms", "whatsapp", "call_description")[i % 7 % 3], sender=("VK-NORTHB", "Mum", "+91 98765 43210", None)[i % 11 % 4]) for i in range(6000)]
    df = spark.createDataFrame(given, ITEM)
    return {g[0]: g for g in given}, {r.id: r for r in variety.diversify(df).collect()}, {r.id: r for r in variety.diversify(df.repartition(5)).collect()}


def share(rows):
    rows = list(rows)
    return sum(map(bool, rows)) / len(rows)


def test_variation_is_fixed_and_keeps_quotes(varied):
    given, got, again = varied
    assert got == again and set(got) == set(given)
    assert all(f.quote in r.text for r in got.values() for f in r.red_flags)


def test_ids_and_emoji(varied):
    given, got, _ = varied
    tails = {i: r.text.removeprefix(given[i][1]) for i, r in got.items()}
    endings = re.compile("|".join(re.escape(label) + rf"\d{{{least},{most}}}" for label, least, most in (*variety.ENDINGS, variety.HINDI_ENDING)))
    with_id = {i for i, t in tails.items() if endings.search(t)}
    assert not any(got[i].category in variety.WITHOUT_ID for i in with_id)
    for v in ("SCAM", "SUSPICIOUS"):
        assert share(i in with_id for i, r in got.items() if r.verdict == v) == pytest.approx(0.40, abs=0.06)
    assert all(t.startswith("\n") <= (given[i][5] == "whatsapp") for i, t in tails.items()) and share(tails[i].startswith("\n") for i in with_id if given[i][5] == "whatsapp") == pytest.approx(0.3, abs=0.1)
    assert share(variety.HINDI_LABEL in tails[i] for i in with_id if given[i][4] == "hi") == pytest.approx(0.5, abs=0.12) and not any(variety.HINDI_LABEL in tails[i] for i in with_id if given[i][4] == "en")
    assert len({endings.search(tails[i])[0].rstrip("0123456789") for i in with_id}) == len(variety.ENDINGS) + 1
    signs = {e for own in variety.EMOJI.values() for e in own}
    cheer = {i for i, t in tails.items() if any(e in t for e in signs)}
    assert {got[i].category for i in cheer} == set(variety.EMOJI) and share(i in cheer for i, r in got.items() if r.category in variety.EMOJI) == pytest.approx(0.15, abs=0.03)


def test_senders_and_channels(varied):
    given, got, _ = varied
    for v in ("SCAM", "SAFE", "SUSPICIOUS"):
        rows = [(given[i], r) for i, r in got.items() if r.verdict == v and r.category != "personal"]
        assert share(r.sender is None for _, r in rows) == pytest.approx(0.5, abs=0.05)
        assert share(r.channel == "screenshot" for g, r in rows if g[5] != "call_description") == pytest.approx(0.15, abs=0.04)
    assert all(r.channel == given[i][5] for i, r in got.items() if given[i][5] == "call_description")
    kept = [(given[i], r) for i, r in got.items() if r.sender is not None]
    assert all(re.fullmatch(r"[A-Z]{2}-[A-Z0-9]{3,9}|\+91 [6-9]?\d{4,5} \d{5}", r.sender) for _, r in kept if r.category != "personal")
    assert any(r.sender == "Mum" for _, r in kept)
    spoofed = [r.sender != g[6] for g, r in kept if r.verdict != "SAFE" and g[5] != "call_description" and g[6] == "+91 98765 43210"]
    assert share(spoofed) == pytest.approx(0.2, abs=0.08)
    contacts = [r.sender.startswith("+91") for g, r in kept if r.category == "personal" and g[5] != "call_description" and g[6] in ("Mum", "VK-NORTHB")]
    assert share(contacts) == pytest.approx(0.45 / 0.85, abs=0.1)


@pytest.mark.parametrize(("text", "left"), [("Dear [bank name]", True), ("Dear <Your Name>,", True), ("[OTP] is it", False), ("<OTP> <ACCT>", False), ("[ACCT 12]", False), ("[OTPS]", True), ("a < b and c > d", True), ("a < b1 > c", False), ("[]", True), ("no", False)])
def test_placeholders_left(spark, text, left):
    assert spark.createDataFrame([(text,)], "t string").select(messages.has_placeholder(F.col("t")).alias("p")).first().p is left


def test_doubts(spark):
    data = rules.Dictionary(sites=("bank.test",), phrases={"urgency": ("now",), "payment": ("pay",), "otp": ("otp",), "share": ("send",), "negation": ("not",)})
    rows = [item(1, "pay now", "SAFE", "personal"), item(2, "send me the otp", "SAFE", "personal"), item(3, "see www.other.test/x", "SAFE", "personal"), item(4, "see www.bank.test/x", "SAFE", "personal"), item(5, "pay now [name]", "SCAM"), item(6, "नमस्ते"), item(7, "hello", language="hi")]
    df = spark.createDataFrame(rows, ITEM).withColumn("m", T.normalize_message(F.col("text"), F.col("sender")))
    got = {r.reason: (r["count"], r.share) for r in split.suspects(df, messages.doubts(df, rules.Rules(data), F.col("m"))).collect()}
    want = {k: 1 for k in ("safe_urgency_payment", "safe_otp_ask", "safe_nonofficial_link", "placeholder", "lang_en_with_devanagari", "lang_hi_without_devanagari")} | {None: 6}
    assert {k: n for k, (n, _) in got.items()} == want and got[None][1] == pytest.approx(6 / 7)
    assert split.suspects(df.filter("false"), messages.doubts(df, rules.Rules(data), F.col("m"))).count() == 0


def test_targets_attributes_and_label_only(spark):
    df = spark.createDataFrame([("UNKNOWN", None, {"a": "x" * 100, "b": "y", "n": None}, {"a": ["z" * 90, "w"], "c": ["v"], "d": [None]})], "v string, c string, m map<string,string>, l map<string,array<string>>")
    r = df.select(
        messages.target_json(F.col("v"), F.col("c"), F.array().cast(messages.FLAGS)).alias("t"), messages.allowed_attributes(F.col("m"), ["a", "n"]).alias("m"), messages.allowed_lists(F.col("l"), ["a", "d"]).alias("l"),
    ).first()
    assert r.t == '{"verdict":"UNKNOWN","category":null,"red_flags":[]}' and r.m == {"a": "x" * 80} and r.l == {"a": ["z" * 80, "w"]}
    labels = spark.createDataFrame([("SCAM",), ("SUSPICIOUS",), ("SAFE",), ("ODD",)], "v string").select("v", rules.label_only(F.col("v")).alias("p")).collect()
    assert [(x.v, x.p and tuple(x.p)) for x in labels] == [("SCAM", (1.0, 0.0)), ("SUSPICIOUS", (0.0, 0.0)), ("SAFE", (0.0, 1.0)), ("ODD", None)]


def test_hard_negatives(spark):
    rows = [("SAFE", "genuine_otp", "x"), ("SAFE", "personal", "Your KYC is due"), ("SAFE", "personal", "hello"), ("SCAM", "genuine_otp", "urgent"), ("SAFE", None, "Suspended")]
    got = spark.createDataFrame(rows, "v string, c string, t string").select(messages.hard_negative_wide(F.col("v"), F.col("c"), F.col("t")).alias("h")).collect()
    assert [r.h for r in got] == [True, True, False, False, True]
    assert len(list(itertools.chain(messages.ALARMS))) == len(set(messages.ALARMS))
