"""Explanations, flags, categories, placeholders, the pool and the systems, against cases and brute force."""

import hashlib
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewarden.functions import scoring
from tidewarden.functions import text as T
from tidewarden.operators import messages, metrics, pool, split
from tidewarden.plans import hub

FLAG = "array<struct<quote: string, reason: string>>"


@pytest.mark.parametrize(
    "said, verdict, language, message, want",
    [
        ("This is a scam. Hang up.", "SCAM", "en", "x", []),
        ("There is no scam here.", "SCAM", "en", "x", ["negated_verdict_word"]),
        ("It isn't a scam.", "SCAM", "en", "x", ["negated_verdict_word"]),
        ("Do not reply, it is a scam.", "SCAM", "en", "x", []),
        ("Never ever in my life a scam", "SCAM", "en", "x", []),
        ("Cannot be a scam", "SCAM", "en", "x", ["negated_verdict_word"]),
        ("Hang up now.", "SCAM", "en", "x", ["verdict_word_missing"]),
        ("A scam, quite normal.", "SCAM", "en", "x", ["other_verdict_word"]),
        ("A scam. We couldn’t check more.", "SCAM", "en", "x", ["other_verdict_word"]),
        ("Be careful, a scam perhaps", "SUSPICIOUS", "en", "x", ["other_verdict_word"]),
        ("Be careful with own.com", "SUSPICIOUS", "en", "see OWN.com.", []),
        ("Be careful with other.com", "SUSPICIOUS", "en", "see own.com", ["foreign_url"]),
        ("Be careful with 55 and ५६", "SUSPICIOUS", "en", "55 or 56", []),
        ("Be careful with 55", "SUSPICIOUS", "en", "x", ["foreign_number"]),
        ("Be careful. One. Two! Three?", "SUSPICIOUS", "en", "x", ["too_many_sentences"]),
        ("Be careful " + "so " * 60, "SUSPICIOUS", "en", "x", ["too_many_words"]),
        ("यह स्कैम है।", "SCAM", "hi", "x", []),
        ("यह स्कैम नहीं है।", "SCAM", "hi", "x", ["negated_verdict_word"]),
        ("यह सामान्य और ठगी है", "SCAM", "hi", "x", ["other_verdict_word"]),
    ],
)
def test_explanation_problems(spark, said, verdict, language, message, want):
    row = spark.createDataFrame([(said, verdict, message)], "s string, v string, t string")
    assert row.select(messages.explanation_problems(F.col("s"), F.col("v"), language, F.col("t")).alias("p")).first().p == want


def test_clean_flags_normalises_a_text_once(spark, tiny):
    plan = hub.clean_flags(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(hub._UNPLAIN) == 1
    assert re.search(r"\w+\(text#\d+, \[\^", plan) is None  # no class is negated


def test_valid_items_normalise_a_text_once(spark, tiny):
    from tidewarden.plans import text as plans

    plan = plans.valid_items(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("^ | $") == 2  # of the text and of a quote
    rows = [("a", " x\u00a0y\n", "SAFE", "personal", None, 1, " unknown "), ("b", "x", "SCAM", "apk_link", [("x", "apk_link")], 2, "s"), ("c", "see  x", "SCAM", "other_scam", [("see x", "apk_link")], 3, "s"), ("d", None, "SAFE", "personal", None, 4, None), ("e", "\u200b", "SAFE", "personal", [], 5, None), ("f", "x", "SAFE", "personal", [("y", "apk_link")], 6, None)]
    items = spark.createDataFrame(rows, f"id string, text string, verdict string, category string, red_flags {FLAG}, `a.b` int, sender string")
    good = messages.valid_items(items)
    assert good.columns == items.columns
    assert sorted(map(tuple, good.collect())) == [("a", "x y", "SAFE", "personal", [], 1, None), ("c", "see x", "SCAM", "other_scam", [("see x", "apk_link")], 3, "s")]


def test_clean_flags(spark):
    text = "Visit own.com/app.apk and share the OTP now"
    cases = [
        ([("own.com/app.apk", "apk_link"), ("own.com/app.apk", "apk_link")], [("own.com/app.apk", "apk_link")]),
        ([("Visit", "apk_link")], None),
        ([("Visit", "lookalike_link"), ("share the OTP", "asks_otp_or_pin")], [("share the OTP", "asks_otp_or_pin")]),
        ([("now", "asks_otp_or_pin")], None),
        ([("ＯＴＰ", "asks_otp_or_pin")], [("OTP", "asks_otp_or_pin")]),
        ([("n", "asks_payment")], None),
        ([("not there", "asks_payment"), ("now", "asks_payment")], None),
        ([("now", "of no kind")], None),
        ([], None),
        (None, None),
    ]
    rows = spark.createDataFrame([(i, text, f) for i, (f, _) in enumerate(cases)], f"i int, t string, f {FLAG}")
    for r in rows.select("i", messages.clean_flags(F.col("f"), F.col("t")).alias("f")).collect():
        assert (None if r.f is None else [tuple(x) for x in r.f]) == cases[r.i][1], cases[r.i]


def test_safe_category(spark):
    cases = [
        ("personal", "see you at 5566", "unknown", "personal"), ("personal", "code <OTP>", "unknown", None), ("personal", "hi", "registered", None), ("genuine_otp", "code <OTP>", "registered", "genuine_otp"), ("genuine_otp", "your parcel", "registered", "delivery_update"),
        ("legit_promo", "PF statement", "registered", "govt_genuine"), ("legit_promo", "helpful pfennig", "registered", None), ("transaction_alert", "nothing", "unknown", None), ("delivery_update", "big sale of parcels", "registered", "delivery_update"),
    ]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, d string, t string, s string")
    for r in rows.select("i", messages.safe_category(F.col("d"), F.col("t"), F.col("s")).alias("c")).collect():
        assert r.c == cases[r.i][3], cases[r.i]


def brute_draw(seed, what, key):
    return int(hashlib.sha256(f"{seed}|{what}|{key}".encode()).hexdigest()[:12], 16) / 2**48


def brute_fill(key, text, flags, seed=7):
    spans = []
    for i, m in enumerate(re.finditer("<OTP>|<ACCT>", text)):
        u = lambda what: brute_draw(seed, what, f"{key}|{i}")  # noqa: E731, B023
        digits = lambda n: str(int(u("digits") * 10**12)).zfill(12)[-n:]  # noqa: E731, B023
        size = lambda a, b: a + int(u("size") * (b - a + 1))  # noqa: E731, B023
        previous = spans[-1][1] if spans else 0
        left = text[previous : m.start()][-14:].lower()
        if m[0] == "<OTP>":
            value = digits(size(4, 6))
        elif left.rstrip().endswith(split.LAST_FOUR):
            value = digits(4)
        elif re.search("(?:" + "|".join(map(re.escape, split.NUMBERED)) + r")\W{0,4}$", left):
            value = digits(size(6, 12))
        else:
            value = "XX" + digits(4) if u("form") < 1 / 3 else "**" + digits(4) if u("form") < 2 / 3 else digits(size(6, 12))
        spans.append((m.start(), m.end(), value))
    if not spans:  # left as it is
        return text, flags
    put = lambda a, b: "".join(_pieces(text, spans, a, b))
    kept = []
    for quote, reason in flags:
        a = text.find(quote)
        if a >= 0 and not any(s < a < e or s < a + len(quote) < e for s, e, _ in spans):
            kept.append((put(a, a + len(quote)), reason))
    return put(0, len(text)), kept


def _pieces(text, spans, a, b):
    at = a
    for s, e, v in spans:
        if a <= s and e <= b:
            yield from (text[at:s], v)
            at = e
    yield text[at:b]


def test_placeholders_by_brute_force(spark):
    rnd = random.Random(4)
    parts = ["code <OTP>", " account ending <ACCT>", " ref no. <ACCT>,", " a/c <ACCT>", " XX<ACCT>", " plain words", " <OTP><ACCT>"]
    rows = []
    for i in range(60):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 6)))
        cuts = sorted(rnd.sample(range(len(text) + 1), 2))
        rows.append((i, rnd.choice(("SCAM", "SAFE")), text, [(text[:12], "asks_payment"), (text[slice(*cuts)], "asks_payment"), ("not there", "asks_payment")]))
    got = {r.id: r for r in split.fill_placeholders(spark.createDataFrame(rows, f"id int, verdict string, text string, red_flags {FLAG}")).collect()}
    for i, verdict, text, flags in rows:
        want, kept = brute_fill(i, text, flags)
        if verdict == "SCAM" and not kept:
            assert i not in got
            continue
        assert got[i].text == want and [tuple(f) for f in got[i].red_flags] == kept, (text, flags)


def test_filled_placeholders_query(spark, tiny):
    rows = {r.id: r.text for r in hub._items(spark, tiny).collect()}
    got = hub.filled_placeholders(spark, tiny).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == brute_fill(r.id, "code <OTP> for account ending <ACCT>, ref no. <ACCT>. " + rows[r.id], [])[0] and r.n_flags == 1


def test_node(spark):
    def work(batch):
        if (batch["id"] == 3).any():
            raise KeyError("gone")
        return pd.DataFrame({"double": batch["id"] * 2}, index=batch.index)

    rows = spark.range(4).repartition(4, "id")
    stage = scoring.node("twice", work, "double long")
    again = scoring.node("more", lambda b: pd.DataFrame({"n": b["id"]}, index=b.index), "n long")
    got = {r.id: r for r in again(stage(rows)).collect()}
    failed = {i for i, r in got.items() if r.errors}
    assert 3 in failed and all(r.errors == ["twice:KeyError"] and r.double is None for i, r in got.items() if i in failed)
    assert all(r.double == 2 * i for i, r in got.items() if i not in failed) and all(set(r.timings_ms) == {"twice", "more"} for r in got.values())


def test_systems(spark):
    kind = "id long, seed_group string, channel string, sender string, text string, signals array<string>"
    items = spark.createDataFrame([(1, "g1", "sms", None, "you will be arrested", []), (2, "g2", "sms", None, "see you", [])], kind)
    got = {r.id: r for r in scoring.SYSTEMS["rules_only"](items).collect()}
    assert (got[1].pred_verdict, got[1].pred_quotes) == ("SUSPICIOUS", ["arrested"]) and (got[2].pred_verdict, got[2].pred_quotes) == ("UNKNOWN", [])
    shots = spark.createDataFrame([(9, "g1", 1, "u", "a")], "id long, seed_group string, position int, user string, assistant string")
    with pytest.raises(ValueError, match="overlap"):
        scoring.prompted(lambda x: ["{}"] * len(x), "s", shots)(items)

    def down(lists):
        raise ConnectionError("no")

    failed = scoring.prompted(down, "s", shots.withColumn("seed_group", F.lit("g9")))(items).collect()
    assert {(r.pred_verdict, r.error) for r in failed} == {("UNKNOWN", "ConnectionError")}


def test_pool_helpers(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    assert pool.checked_ids(rows) is rows
    for bad in (rows.filter("false"), rows.unionByName(rows), rows.unionByName(spark.createDataFrame([(None,)], "id long"))):
        with pytest.raises(ValueError):
            pool.checked_ids(bad)
    assert spark.range(1).select(pool.html_escaped(F.lit("<a href=\"x\">'&'")).alias("h")).first().h == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;"


def brute_ratio(x, y):
    x, y = " ".join(x.split()), " ".join(y.split())
    row = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, c in enumerate(x, 1):
        for j, d in enumerate(y, 1):
            row[i][j] = row[i - 1][j - 1] + 1 if c == d else max(row[i - 1][j], row[i][j - 1])
    return 2 * row[-1][-1] / (len(x) + len(y)) if x or y else 1.0


def test_edit_similarity_by_brute_force(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("ab cé") for _ in range(rnd.randint(0, 90)))
    rows = [(i, word(), word()) for i in range(80)] + [(80, "", "")]
    for r in spark.createDataFrame(rows, "i int, a string, b string").select("i", "a", "b", T.edit_similarity(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == pytest.approx(brute_ratio(r.a, r.b)), r


def test_places_are_a_whole_order(spark):
    rows = spark.range(5000)
    got = {r.id: r.place for r in split.placed(rows, split.draw(3, "x", F.col("id")), "id", buckets=7).collect()}
    want = {i: k for k, i in enumerate(sorted(range(5000), key=lambda i: (brute_draw(3, "x", i), i)))}
    assert got == want


def test_runs_by_digest_puts_the_current_last(spark):
    rows = [("b", 1, "d1", 0.5, None), ("a", 1, "d2", 0.3, 0.2)]
    got = metrics.runs_by_digest(spark.createDataFrame(rows, "run string, epoch int, digest string, macro_f1 double, recall double"), "d2").orderBy("place").collect()
    assert [r.digest for r in got] == ["d1", "d2"] and got[1].is_current
