"""Validation, red-flag cleaning, prompts and replies: row-wise expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import CHANNELS, DETECTOR_VERDICTS, LANGUAGES, REASONS, SAFE_CATEGORIES, SCAM_CATEGORIES

FLAGS = "array<struct<quote: string, reason: string>>"
CATEGORIES = (*SCAM_CATEGORIES, *SAFE_CATEGORIES)


def problems(text: Column, verdict: Column, category: Column, channel: Column, language: Column, flags: Column, empty_flags_ok: bool = False) -> Column:
    """Names of every rule the item breaks, in a fixed order."""
    own = F.when(verdict == "SAFE", category.isin(*SAFE_CATEGORIES)).otherwise(category.isin(*SCAM_CATEGORIES))
    checks = {
        "empty_text": F.coalesce(text, F.lit("")) == "",
        "bad_verdict": ~F.coalesce(verdict.isin(*DETECTOR_VERDICTS), F.lit(False)),
        "bad_category": ~F.coalesce(own, F.lit(False)),
        "bad_channel": ~F.coalesce(channel.isin(*CHANNELS), F.lit(False)),
        "bad_language": ~F.coalesce(language.isin(*LANGUAGES), F.lit(False)),
        "safe_with_flags": (verdict == "SAFE") & (F.size(flags) > 0),
        "missing_flags": (verdict != "SAFE") & (F.coalesce(F.size(flags), F.lit(0)) <= 0) & F.lit(not empty_flags_ok),
        "bad_reason": F.exists(flags, lambda f: ~f["reason"].isin(*REASONS)),
        "ungrounded_quote": F.exists(flags, lambda f: ~F.contains(text, f["quote"])),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in checks.items()]))


def valid_items(items: DataFrame) -> DataFrame:
    """Items that may enter the pool: text and quotes normalised, quotes grounded, unknown senders null."""
    tidy = F.transform("red_flags", lambda f: F.struct(T.tidy(f["quote"]).alias("quote"), f["reason"].alias("reason")))
    known = items.withColumn("sender", F.when(~F.trim("sender").isin("", "unknown"), F.col("sender")))
    rows = T.with_computed(known, text=T.normal_text(F.col("text")), red_flags=F.coalesce(tidy, F.array().cast(FLAGS))).select(*[F.col(f"`{c}`") for c in items.columns])
    good = (
        (F.col("text") != "") & F.col("verdict").isin(*DETECTOR_VERDICTS) & F.col("category").isin(*CATEGORIES)
        & F.forall("red_flags", lambda f: f["reason"].isin(*REASONS) & F.contains(F.col("text"), f["quote"])) & ((F.col("verdict") == "SAFE") | (F.size("red_flags") > 0))
    )
    return rows.filter(good)


def quote_fits(quote: Column, reason: Column) -> Column:
    """The quote has the surface that its reason needs: a link for the two link reasons (one to an app for ``apk_link``), a word for a code for ``asks_otp_or_pin``."""
    link = quote.rlike(r"(?iU)\w\.[a-z]{2}") | F.contains(quote, F.lit("/"))
    app = F.contains(F.lower(quote), F.lit(".apk"))
    secret = F.exists(F.array(*map(F.lit, CODE_PARTS)), lambda w: F.contains(F.lower(quote), w))
    return F.when(reason == "apk_link", link & app).when(reason == "lookalike_link", link).when(reason == "asks_otp_or_pin", secret).otherwise(True)


# What a quote that asks for a code holds.
CODE_PARTS = ("otp", "pin", "code", "password", "cvv", "ओटीपी", "पिन", "कोड", "पासवर्ड")


def clean_flags(flags: Column, text: Column) -> Column:
    """Of the first six flags, quotes in normal form: null if one is shorter than 2 characters, not in the text or of an unknown reason; else the distinct ones that fit their reason, four at most; null if none does."""
    six = F.slice(flags, 1, 6)
    quotes = F.split(T.normal_text(F.array_join(F.transform(six, lambda f: F.coalesce(F.replace(f["quote"], F.lit("\n"), F.lit(" ")), F.lit(""))), "\ue000")), "\ue000", -1)  # one call of Python for all quotes

    def judged(own: Column) -> Column:
        sound = F.forall(own, lambda f: (F.length(f["quote"]) >= 2) & F.contains(text, f["quote"]) & F.coalesce(f["reason"].isin(*REASONS), F.lit(False)))
        kept = F.slice(F.filter(F.array_distinct(own), lambda f: quote_fits(f["quote"], f["reason"])), 1, 4)
        return F.when(sound & (F.size(kept) > 0), kept)

    tidy = F.zip_with(six, quotes, lambda f, q: F.struct(F.trim(q).alias("quote"), f["reason"].alias("reason")))
    return F.when(F.size(six) > 0, T.let(tidy, judged))


# Masks that may stand where a placeholder may not.
SPARED = ("OTP", "ACCT", "PHONE")


def has_placeholder(text: Column) -> Column:
    """A stretch in square brackets, or letters in angle brackets, that is left to fill in; masks are none."""
    square = F.regexp_extract_all(text, F.lit(r"\[([^\[\]]{0,40})\]"), 1)
    angle = F.regexp_extract_all(text, F.lit("<([A-Za-z ]{2,30})>"), 1)
    begun = rf"^(?:{'|'.join(SPARED)})(?:$|[^\p{{L}}\p{{N}}_])"
    return F.exists(square, lambda x: ~x.rlike(begun)) | F.exists(angle, lambda x: ~x.isin(*SPARED))


def acceptable(text: Column, verdict: Column, category: Column, status: Column, flags: Column, urls: Column, hard: Column, soft: Column) -> Column:
    """A generated message of 8-700 characters that fits its verdict."""
    sized = F.length(text).between(8, 700) & ~has_placeholder(text)
    safe = ((status == "registered") | (category == "personal")) & (F.size(hard) == 0)
    plain = (F.size(urls) == 0) & (F.size(F.array_except(soft, F.array(F.lit("unregistered_sender")))) == 0) & (F.size(hard) == 0)
    return sized & F.when(verdict == "SAFE", safe).when(verdict == "SUSPICIOUS", flags.isNotNull() & plain).otherwise(flags.isNotNull())


def acceptable_call(text: Column, urls: Column, hard: Column, soft: Column) -> Column:
    return F.length(text).between(8, 500) & (F.size(urls) == 0) & (F.size(hard) == 0) & (F.size(F.array_except(soft, F.array(F.lit("unregistered_sender")))) == 0)


def acceptable_link(text: Column, urls: Column, wanted: Column, allowed: list[str], soft: Column, barred=("shortener_link", "urgency_plus_payment", "asks_otp_or_pin")) -> Column:
    ours = F.forall(urls, lambda u: T.host(u).isin(*allowed))
    return (F.size(urls) > 0) & ours & F.contains(text, wanted) & ~F.arrays_overlap(soft, F.array(*map(F.lit, barred)))


def relabelled_language(asked: Column, text: Column) -> Column:
    """By the Devanagari share of the letters; the thresholds depend on the language asked for."""
    share = F.coalesce(F.try_divide(F.regexp_count(text, F.lit("[\\u0900-\\u097F]")), F.regexp_count(text, F.lit("[\\p{L}\\u0900-\\u097F]"))), F.lit(0.0))
    hi = F.when(share >= 0.6, "hi").when(share >= 0.3, "hi").otherwise("hinglish")
    mixed = F.when(share >= 0.6, "hi").otherwise("hinglish")
    en = F.when(share >= 0.6, "hi").when(share >= 0.1, "hinglish").otherwise("en")
    return F.when(asked == "hi", hi).when(asked == "hinglish", mixed).otherwise(en)


HARD_NEGATIVE_KINDS = ("genuine_otp", "transaction_alert")


def hard_negative(verdict: Column, category: Column) -> Column:
    return (verdict == "SAFE") & F.coalesce(category.isin(*HARD_NEGATIVE_KINDS), F.lit(False))


# What makes a genuine message alarming.
ALARMS = (
    "do not share", "don't share", "never asks", "debited", "not done by you", "not you", "blocked", "suspend", "urgent", "kyc", "expire", "turant", "nahi kiya",
    "share na karein", "साझा न करें", "तुरंत", "डेबिट", "केवाईसी", "समाप्त",
)


def hard_negative_wide(verdict: Column, category: Column, text: Column) -> Column:
    """Genuine, and of one of the two kinds or alarming in its words."""
    alarming = F.exists(F.array(*map(F.lit, ALARMS)), lambda w: F.contains(F.lower(text), w))
    return (verdict == "SAFE") & (F.coalesce(category.isin(*HARD_NEGATIVE_KINDS), F.lit(False)) | alarming)


def doubts(items: DataFrame, rules, normalized: Column) -> dict[str, Column]:
    """The six reasons to look at an item by hand: what the rules say of a genuine one, what is left to fill in, its language.

    Needs text, verdict and language; ``rules`` is a rules.Rules, ``normalized`` its struct of the message.
    """
    safe = F.col("verdict") == "SAFE"
    soft = rules.evaluate(normalized)["soft"]
    fires = lambda k: safe & F.array_contains(soft, k)
    strange = F.exists(rules.linked(normalized["urls"]), lambda x: ~x["ours"])
    devanagari = F.col("text").rlike("[\\x{0900}-\\x{097F}]")
    return {
        "safe_otp_ask": fires("asks_otp_or_pin"), "safe_urgency_payment": fires("urgency_plus_payment"), "safe_nonofficial_link": safe & strange, "placeholder": has_placeholder(F.col("text")),
        "lang_hi_without_devanagari": (F.col("language") == "hi") & ~devanagari, "lang_en_with_devanagari": (F.col("language") == "en") & devanagari,
    }


# In the order of preference, words of which one stands in a message of the kind.
SAFE_WORDS = {
    "genuine_otp": ("<otp>",),
    "delivery_update": ("deliver", "parcel", "order", "shipment", "courier", "package", "dispatch", "out for", "track", "डिलीवरी", "पार्सल", "ऑर्डर", "शिपमेंट", "कूरियर"),
    "govt_genuine": ("income tax", "itr", "epfo", "uidai", "aadhaar", "electricity", "bijli", "bill", "ration", "pension", "passport", "msedcl", "govt", "government", "आयकर", "बिजली", "बिल", "आधार", "पेंशन", "सरकार", "राशन", "पासपोर्ट"),
    "legit_promo": ("offer", "sale", "cashback", "discount", "% off", "recharge", "plan", "coupon", "reward", "ऑफर", "छूट", "कैशबैक", "रिचार्ज", "सेल"),
    "transaction_alert": ("debit", "credit", "a/c", "account", "kyc", "transaction", "transfer", "खाते", "खाता", "डेबिट", "क्रेडिट", "केवाईसी", "लेनदेन"),
}
SAFE_WHOLE_WORDS = {"govt_genuine": ("pf",)}


def safe_category(declared: Column, text: Column, status: Column) -> Column:
    """personal stays if the sender is not registered and no code is masked, else null; another kind stays if a word of it stands in the text, else the first kind that fits; null if none does."""
    low = F.lower(text)

    def fits(kind: str) -> Column:
        said = F.exists(F.array(*map(F.lit, SAFE_WORDS[kind])), lambda w: F.contains(low, w))
        return F.greatest(said, *[low.rlike(rf"(?U)\b{w}\b") for w in SAFE_WHOLE_WORDS.get(kind, ())]) if kind in SAFE_WHOLE_WORDS else said

    if_genuine = F.contains(text, F.lit("<OTP>"))
    found = {k: (if_genuine if k == "genuine_otp" else fits(k)) for k in SAFE_WORDS}
    first = F.coalesce(*[F.when(c, F.lit(k)) for k, c in found.items()])
    own = F.coalesce(*[F.when((declared == k) & c, F.lit(k)) for k, c in found.items()])
    personal = F.when((status != "registered") & ~if_genuine, "personal")
    return F.when(declared == "personal", personal).when(declared.isin(*SAFE_WORDS), F.coalesce(own, first))


# -- prompts ------------------------------------------------------------------
def user_message(channel: Column, sender: Column, status: Column, signals: Column, text: Column) -> Column:
    names = F.array_join(F.array_sort(F.array_distinct(signals)), ", ")
    return F.concat(F.lit("CHANNEL: "), channel, F.lit("\nSENDER: "), F.coalesce(sender, F.lit("unknown")), F.lit(" ("), status, F.lit(")\nRULE_SIGNALS: ["), names, F.lit("]\nMESSAGE:\n"), text)


def target_json(verdict: Column, category: Column, flags: Column) -> Column:
    return F.to_json(F.struct(verdict.alias("verdict"), category.alias("category"), F.coalesce(flags, F.array().cast(FLAGS)).alias("red_flags")), {"ignoreNullFields": "false"})  # UNKNOWN has a null category, and says so


def chat(system: Column, user: Column, assistant: Column) -> Column:
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", system), turn("user", user), turn("assistant", assistant))


def parse_user_message(content: Column) -> Column:
    """The inverse of user_message; null where the layout differs."""
    pattern = r"(?s)\ACHANNEL: ([^\n]*)\nSENDER: ([^\n]*) \((registered|unregistered|unknown)\)\nRULE_SIGNALS: \[([^\n]*)\]\nMESSAGE:\n(.*)\z"
    part = lambda i: F.regexp_extract(content, pattern, i)
    signals = F.filter(F.split(part(4), ", "), lambda x: x != "")
    return F.when(content.rlike(pattern), F.struct(part(1).alias("channel"), F.nullif(part(2), F.lit("unknown")).alias("sender"), part(3).alias("sender_status"), signals.alias("signals"), part(5).alias("text")))


_REPLY = "verdict string, category string, red_flags array<struct<quote: string, reason: string>>"


def split_items(rows: DataFrame) -> DataFrame:
    """Items of a split file, rows of ``messages`` (role, content) and ``meta``: the prompt's parts, and the target as gold.

    In file order, as ``ordinal`` if the rows have one; a row whose prompt or target has another layout has nulls there.
    """
    said = lambda role: F.get(F.filter("messages", lambda m: m["role"] == role), F.lit(0))["content"]
    parts = rows.select("*", parse_user_message(said("user")).alias("_p"), F.from_json(said("assistant"), _REPLY).alias("_g"))
    gold = {f"gold_{k}": F.col(f"_g.{k}") for k in ("verdict", "category", "red_flags")}
    return parts.withColumns({"id": F.col("meta.id").cast("string"), **{k: F.col(f"_p.{k}") for k in ("channel", "sender", "signals", "text")}, **gold}).drop("_p", "_g")


def parse_reply(raw: Column) -> Column:
    """Lenient: fences off, first brace to last; verdict in capitals or UNKNOWN; strict flag for an exact reply."""
    inner = F.regexp_extract(T.unfence(raw), r"(?s)\{.*\}", 0)
    got = F.from_json(inner, _REPLY)
    keys = F.json_object_keys(F.trim(raw))
    verdict = F.upper(F.trim(got["verdict"]))
    strict = (
        F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, ("verdict", "category", "red_flags"))))) == 0, F.lit(False)) & got["verdict"].isin(*DETECTOR_VERDICTS) & F.coalesce(got["category"].isin(*CATEGORIES), F.lit(False))
        & F.forall(F.coalesce(got["red_flags"], F.array().cast(FLAGS)), lambda f: f["reason"].isin(*REASONS) & f["quote"].isNotNull())
    )
    parsed = F.coalesce(got["verdict"].isNotNull(), F.lit(False))
    return F.struct(
        F.when(verdict.isin(*DETECTOR_VERDICTS), verdict).otherwise("UNKNOWN").alias("verdict"), F.when(got["category"].isin(*CATEGORIES), got["category"]).alias("category"),
        F.coalesce(F.filter(F.transform(got["red_flags"], lambda f: f["quote"]), lambda q: q.isNotNull()), F.array().cast("array<string>")).alias("quotes"),
        F.coalesce(strict, F.lit(False)).alias("json_valid"), parsed.alias("json_parsed"),
    )


# Words of each verdict in an explanation, words that deny, marks and words between clauses.
VERDICT_WORDS = {
    "en": {"SCAM": ("scam",), "SUSPICIOUS": ("careful", "suspicious"), "SAFE": ("normal",), "UNKNOWN": ("couldn't check", "could not check")},
    "hi": {"SCAM": ("स्कैम", "ठगी", "धोखा"), "SUSPICIOUS": ("सावधान", "संदिग्ध"), "SAFE": ("सामान्य",), "UNKNOWN": ("जाँच नहीं", "जांच नहीं")},
}
FORBIDDEN = {"SCAM": ("SAFE", "UNKNOWN"), "SUSPICIOUS": ("SCAM", "SAFE", "UNKNOWN")}
DENIALS = {"en": ("not", "no", "never", "cannot", "without"), "hi": ("नहीं", "नही", "न", "ना", "मत")}
CLAUSE_MARKS, CLAUSE_WORDS = ",;:\u2014\u2013", ("but", "and", "so")
NEAR_WORDS, MOST_SENTENCES, MOST_WORDS = 3, 3, 60

_BREAKS = (*CLAUSE_MARKS, "-", *CLAUSE_WORDS)


def _clause(text: Column, last: bool) -> Column:
    """Words of the last (or first) clause of a text: those after its last (before its first) mark or word that parts clauses."""
    spaced = F.regexp_replace(text, f"([{CLAUSE_MARKS}])", " $1 ")
    words = F.filter(F.split(spaced, r'(?U)[\s()"\u201C\u201D]+'), lambda t: t != "")

    def cut(own: Column) -> Column:
        parts = F.transform(own, lambda t: t.isin(*_BREAKS))
        if last:
            behind = F.array_position(F.reverse(parts), True)
            return F.when(behind > 0, F.slice(own, F.size(own) - behind.cast("int") + 2, F.greatest(behind.cast("int") - 1, F.lit(0)))).otherwise(own)
        ahead = F.array_position(parts, True)
        return F.when(ahead > 0, F.slice(own, F.lit(1), F.greatest(ahead.cast("int") - 1, F.lit(0)))).otherwise(own)

    return T.let(words, cut)


def _sentences(text: Column) -> Column:
    return F.filter(F.split(text, "[.!?\u0964]+"), lambda s: F.trim(F.regexp_replace(s, r"(?U)\s", " ")) != "")


def denied(sentence: Column, word: str, language: str) -> Column:
    """The word stands in the sentence with a denial among the three words before it in its clause (in Hindi also after it)."""
    parts = F.split(sentence, rf"\Q{word}\E", -1)
    bad = lambda t: t.isin(*DENIALS[language]) | (t.endswith("n't") if language == "en" else F.lit(False))

    def at(k: Column) -> Column:
        before = _clause(F.array_join(F.slice(parts, 1, k), word), True)
        near = F.exists(F.slice(before, F.greatest(F.size(before) - NEAR_WORDS + 1, F.lit(1)), NEAR_WORDS), bad)
        if language == "hi":
            after = _clause(F.array_join(F.slice(parts, k + 1, F.size(parts)), word), False)
            near = near | F.exists(F.slice(after, 1, NEAR_WORDS), bad)
        return near

    return F.when(F.size(parts) > 1, F.exists(F.sequence(F.lit(1), F.size(parts) - 1), at)).otherwise(False)


def explanation_problems(output: Column, verdict: Column, language: str, text: Column) -> Column:
    """Checks that an explanation fails, in a fixed order: its verdict's word missing (then no other word is looked at),
    that word denied, another verdict's word, links or numbers that the message does not have, too long."""
    language = language if language in VERDICT_WORDS else "en"
    words, low = VERDICT_WORDS[language], F.replace(F.lower(output), F.lit("\u2019"), F.lit("'"))
    has = lambda w: F.contains(low, F.lit(w))
    of = lambda table: F.coalesce(*[F.when(verdict == v, c) for v, c in table.items()], F.lit(False))
    said = of({v: F.greatest(F.lit(False), *[has(w) for w in own]) for v, own in words.items()})
    in_any = lambda own: F.exists(_sentences(low), lambda s: F.greatest(F.lit(False), *[denied(s, w, language) for w in own]))
    not_said = of({v: in_any(own) for v, own in words.items()})
    other = of({v: F.greatest(F.lit(False), *[has(w) for o in barred for w in words[o]]) for v, barred in FORBIDDEN.items()})
    strange = F.exists(T.urls(output), lambda u: ~F.contains(F.lower(text), F.rtrim(F.lower(u), F.lit(".,)"))))
    digits = lambda c: F.array_distinct(F.regexp_extract_all(F.translate(c, "०१२३४५६७८९", "0123456789"), F.lit(r"\d+"), 0))
    checks = {
        "verdict_word_missing": ~said, "negated_verdict_word": said & not_said, "other_verdict_word": said & other, "foreign_url": strange, "foreign_number": F.size(F.array_except(digits(output), digits(text))) > 0,
        "too_many_sentences": F.size(_sentences(output)) > MOST_SENTENCES, "too_many_words": F.size(F.filter(F.split(output, r"(?U)\s+"), lambda w: w != "")) > MOST_WORDS,
    }
    return F.array_compact(F.array(*[F.when(c, k) for k, c in checks.items()]))


def with_template(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """explanation: headline, then the sentence of (language, verdict, category), else of category ``default``; ``{name}`` filled in.

    ``templates`` holds a row per language, verdict and category of the closed vocabularies, the headline
    under category ``headline``.  A verdict without rows is read as UNKNOWN, a language without rows as English.
    """
    keys = ["_language", "_verdict"]
    have = templates.select(F.col("language").alias("_language"), F.col("verdict").alias("_verdict")).distinct()
    rows = rows.join(have.select(F.col("_language").alias("language")).distinct().withColumn("_l", F.lit(True)), "language", "left")
    rows = rows.withColumn("_language", F.when(F.col("_l"), F.col("language")).otherwise("en"))
    rows = rows.withColumn("verdict_", F.col("verdict")).join(have.withColumnsRenamed({"_verdict": "verdict_"}).withColumn("_v", F.lit(True)), ["_language", "verdict_"], "left")
    rows = rows.withColumn("_verdict", F.when(F.col("_v"), F.col("verdict_")).otherwise("UNKNOWN"))
    own = templates.select(F.col("language").alias("_language"), F.col("verdict").alias("_verdict"), F.col("category").alias("_category"), F.col("sentence").alias("_own"))
    part = lambda kind, name: own.filter(F.col("_category") == kind).select(*keys, F.col("_own").alias(name))
    rows = rows.withColumn("_category", F.when(~F.col("category").isin("headline", "default"), F.col("category"))).join(own, [*keys, "_category"], "left")
    rows = rows.join(part("default", "_rest"), keys, "left").join(part("headline", "_head"), keys, "left")
    body = F.replace(F.coalesce("_own", "_rest"), F.lit("{name}"), F.coalesce("name", F.lit("")))
    return rows.withColumn("explanation", F.concat(F.col("_head"), F.lit(". "), body)).drop("_l", "_v", "verdict_", "_language", "_verdict", "_category", "_own", "_rest", "_head")


def explained(rows: DataFrame, templates: DataFrame, attempts=()) -> DataFrame:
    """explanation of every row, and the problems of the last draft (``explanation_problems``).

    ``attempts``: functions from a frame to the same with a column ``draft`` (null if the model failed), tried in
    turn for SCAM and SUSPICIOUS.  The first draft without problems counts; a failed model ends the trying; the
    fixed sentence is the fallback, and all that SAFE and UNKNOWN ever get.
    """
    rows = with_template(rows, templates).withColumns({"_fixed": F.col("explanation"), "_said": F.lit(None).cast("string"), "_open": F.col("verdict").isin("SCAM", "SUSPICIOUS"), "explanation_problems": F.array().cast("array<string>")})
    for attempt in attempts:
        rows = attempt(rows)
        found = F.when(F.col("language") == "hi", explanation_problems(F.col("draft"), F.col("verdict"), "hi", F.col("text"))).otherwise(explanation_problems(F.col("draft"), F.col("verdict"), "en", F.col("text")))
        found = F.when(F.coalesce(F.trim("draft"), F.lit("")) == "", F.array(F.lit("empty"))).otherwise(found)
        rows = rows.withColumn("_found", found)
        rows = rows.withColumns({
            "explanation_problems": F.when(F.col("_open") & F.col("draft").isNotNull(), F.col("_found")).otherwise(F.col("explanation_problems")),
            "_said": F.when(F.col("_open") & F.col("draft").isNotNull() & (F.size("_found") == 0), F.trim("draft")).otherwise(F.col("_said")),
            "_open": F.col("_open") & F.col("draft").isNotNull() & (F.size("_found") > 0),
        }).drop("draft", "_found")
    return rows.withColumn("explanation", F.coalesce("_said", "_fixed")).drop("_fixed", "_said", "_open")


def alert_body(name: Column, category: Column, at: Column) -> Column:
    """Fixed sentence without any message text."""
    return F.concat(F.lit("Scam warning for "), name, F.lit(": "), F.coalesce(category, F.lit("other_scam")), F.lit(" at "), F.date_format(at, "HH:mm"))


CONTENT_KEYS = ("text", "quote", "quotes", "explanation", "message", "messages", "content", "prompt", "sender", "image", "audio")


def scrub(df: DataFrame, keys=CONTENT_KEYS) -> DataFrame:
    """Drop content-bearing fields at any depth of structs and arrays, and such map keys."""
    from pyspark.sql import types as t

    gone = {k.lower() for k in keys}

    def clean(col: Column, kind: t.DataType) -> Column | None:
        if isinstance(kind, t.StructType):
            parts = [(f.name, clean(col[f.name], f.dataType)) for f in kind.fields if f.name.lower() not in gone]
            parts = [(n, c) for n, c in parts if c is not None]
            return F.when(col.isNotNull(), F.struct(*[c.alias(n) for n, c in parts])) if parts else None
        if isinstance(kind, t.ArrayType) and isinstance(kind.elementType, (t.StructType, t.ArrayType)):
            probe = []

            def inner(x: Column) -> Column:
                probe.append(clean(x, kind.elementType))
                return probe[-1] if probe[-1] is not None else F.lit(None)

            out = F.transform(col, inner)
            return out if probe[-1] is not None else None
        if isinstance(kind, t.MapType) and isinstance(kind.keyType, t.StringType):
            return F.map_filter(col, lambda k, v: ~F.lower(k).isin(*sorted(gone)))
        return col

    cols = [(f.name, clean(F.col(f.name), f.dataType)) for f in df.schema.fields if f.name.lower() not in gone]
    return df.select(*[c.alias(n) for n, c in cols if c is not None])


def allowed_attributes(attributes: Column, names: list[str], most: int = 80) -> Column:
    """Listed keys of a map of strings, values cut to ``most`` characters; null values go."""
    return F.transform_values(F.map_filter(attributes, lambda k, v: k.isin(*names) & v.isNotNull()), lambda k, v: F.left(v, F.lit(most)))


def allowed_lists(attributes: Column, names: list[str], most: int = 80) -> Column:
    """Listed keys of a map of lists of strings, every string cut to ``most`` characters; lists that hold a null are none, and go."""
    whole = F.map_filter(attributes, lambda k, v: k.isin(*names) & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull()), F.lit(False)))
    return F.transform_values(whole, lambda k, v: F.transform(v, lambda x: F.left(x, F.lit(most))))
