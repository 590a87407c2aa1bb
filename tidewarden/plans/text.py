"""Queries of the text family: normal form, entities, rules, fusion, prompts, replies, redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import Dictionary
from ..operators import messages, redact, rules
from ..streaming import online
from .evaluation import rounded
from .frames import EVAL, ITEMS, duck, view

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_I = f"i AS ({duck(ITEMS)})"
_X = f"e AS ({duck(EVAL)})"

#: Phrases that stand in the bundled documents, so that the signals fire there.
DEMO = Dictionary(
    sites=("example.com", "bank.test"), zones=("example.org",), brands=("site",), short_hosts=("bit.ly", "site7.example"),
    phrases={"threat": ("idiot", "moron", "worthless"), "urgency": ("the and", "with*"), "payment": ("for", "pour", "für"), "bank": ("license",), "govt": ("public", "general"), "otp": ("password", "token", "secret"), "share": ("the",), "negation": ("not",), "install": ("from",), "pin": ("that",), "approve": ("this",), "receive": ("was",)},
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def _items(spark, sf):
    return view(spark, sf, ITEMS, "labels", "documents")


_TIDY = r"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(regexp_replace(x, '[\t\x0b\x0c\r ]+', ' ', 'g'))), lambda x: x <> ''), chr(10))"


@query(f"SELECT doc_id, md5({_TIDY.format(t='text')}) AS digest FROM documents")
def text_normalize(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.normal_text(F.col("text"))).alias("digest"))


_REST = "regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
_HOST = rf"regexp_replace(lower(regexp_replace(regexp_extract({_REST}, '^[^/?#]*'), '^.*@|:\d*$', '', 'g')), '\.$', '')"


@query(rf"SELECT page_id, {_HOST} AS host, regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1) AS path, regexp_matches({_HOST}, '[^\x00-\x7F]|(^|\.)xn--') AS idn FROM pages")
def url_parts(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", T.host(F.col("url")).alias("host"), T.path(F.col("url")).alias("path"), T.is_idn(T.host(F.col("url"))).alias("idn"))


@query(rf"SELECT page_id, list_aggregate(list_transform(regexp_extract_all(html, '(?i)(?:https?://|www\.)[^\s<>\x22'']+'), lambda x: regexp_replace(x, '[.,;:!?)\]}}''\x22’”>]+$', '')), 'string_agg', ' ') AS links FROM pages WHERE regexp_matches(html, '(?i)https?://|www\.')")
def scheme_links(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").filter(F.col("html").rlike(r"(?i)https?://|www\.")).select("page_id", F.array_join(T.links(F.col("html")), " ").alias("links"))


@query(r"SELECT doc_id, array_to_string(list_distinct_ordered, ' ') AS handles FROM (SELECT doc_id, list_filter(h, lambda x, i: list_position(h, x) = i) AS list_distinct_ordered FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_.\-]+@[a-zA-Z]{2,}') AS h FROM documents)) WHERE len(list_distinct_ordered) > 0")
def payment_handles(spark, sf):
    rows = _docs(spark, sf).filter(F.contains("text", F.lit("@"))).select("doc_id", T.handles(F.col("text")).alias("h"))
    return rows.filter(F.size("h") > 0).select("doc_id", F.array_join("h", " ").alias("handles"))


@query()
def extract_entities(spark, sf):
    """Links, phones and handles of every document (look-around patterns have no counterpart in the SQL engine)."""
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", F.array_join(T.urls(t), " ").alias("urls"), F.array_join(T.phones(t), " ").alias("phones"), F.array_join(T.handles(t), " ").alias("handles"))


@query(f"WITH {_I} SELECT id, CASE WHEN sender IS NULL THEN 'unknown' WHEN regexp_matches(upper(trim(sender)), '^[A-Z]{{2}}-[A-Z0-9]{{3,9}}(-[A-Z])?$') THEN 'registered' WHEN regexp_matches(sender, '^\\+?[0-9 ()-]*[0-9][0-9 ()-]*$') THEN 'unregistered' ELSE 'unknown' END AS status FROM i")
def sender_status(spark, sf):
    return _items(spark, sf).select("id", T.sender_status(F.col("sender")).alias("status"))


def _w(phrases: str) -> str:
    b = r"[^\p{L}\p{N}_\x{0900}-\x{097F}]"
    return f"(?i)(^|{b})({phrases})($|{b})"


_NUM = "sender = '+14155550100'"
_GOV = f"regexp_matches(text, '{_w('public|general')}')"


@query(
    f"WITH {_I}, s AS (SELECT id, regexp_matches(text, '{_w('idiot|moron|worthless')}') AS threat, regexp_matches(text, '{_w('the +and|with[a-z]*')}') AND regexp_matches(text, '{_w('for|pour|für')}') AS urgency, coalesce({_NUM}, false) AND ({_GOV} OR regexp_matches(text, '{_w('license')}')) AS claim, coalesce({_NUM}, false) AND {_GOV} AS abroad FROM i) "
    "SELECT id, threat AS threat_lexicon, claim AS unregistered_sender FROM s"
)
def simple_signals(spark, sf):
    rows = _items(spark, sf)
    n = F.struct(F.col("text"), F.col("sender"), T.sender_status(F.col("sender")).alias("sender_status"), F.array().cast("array<string>").alias("urls"), F.array().cast("array<string>").alias("phones"))
    found = rules.Rules(DEMO).evidence(n)
    return rows.select("id", (F.size(found["threat_lexicon"]) > 0).alias("threat_lexicon"), (F.size(found["unregistered_sender"]) > 0).alias("unregistered_sender"))


@query()
def rule_signals(spark, sf):
    """All nine signals of every message."""
    rows = _items(spark, sf).withColumn("n", T.normalize_message(F.col("text"), F.col("sender"))).withColumn("s", rules.Rules(DEMO).evaluate(F.col("n")))
    return rows.select("id", F.array_join("s.hard", ",").alias("hard"), F.array_join("s.soft", ",").alias("soft"), F.size("s.evidence").alias("n_evidence"))


@query()
def online_check(spark, sf):
    """The batch form of the per-message pipeline, with integer arithmetic in the detector's place."""

    def scorer(df):
        p = ((F.col("id") * 104729 + 17) % 1000 / 1000).alias("p")
        return df.withColumns({"p_scam": F.when(F.col("id") % 13 != 0, p), "p_safe": F.when(F.col("id") % 13 != 0, 1 - p), "det_category": F.lit("other_scam")})

    events = _items(spark, sf).select("id", F.lit("p1").alias("parent_id"), F.lit("2026-01-01 10:00:00").cast("timestamp").alias("created_at"), "channel", "text", "sender")
    return online.check_messages(events, scorer, DEMO).select("id", "verdict", "category", F.size(F.coalesce("red_flags", F.array().cast("array<struct<quote:string,reason:string,source:string>>"))).alias("n_flags"))


_HS = "CASE WHEN id % 17 = 0 THEN 1 ELSE 0 END AS nh, id % 4 AS ns, CASE WHEN id % 19 <> 0 THEN score / 1000.0 END AS ps, CASE WHEN id % 19 <> 0 AND id % 5 <> 0 THEN 1 - score / 1000.0 END AS pf"


@query(f"WITH {_X}, x AS (SELECT id, {_HS} FROM e) SELECT id, CASE WHEN nh > 0 THEN 'SCAM' WHEN ps IS NULL THEN CASE WHEN ns > 0 THEN 'SUSPICIOUS' ELSE 'UNKNOWN' END WHEN ps >= 0.8 THEN 'SCAM' WHEN coalesce(1 - pf, ps) >= 0.35 OR ns >= 2 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict, CASE WHEN nh > 0 THEN 'SCAM' WHEN ns > 0 THEN 'SUSPICIOUS' ELSE 'UNKNOWN' END AS rules_only, round(coalesce(1 - pf, ps), 6) AS risk FROM x")
def fusion(spark, sf):
    x = view(spark, sf, f"SELECT id, {_HS} FROM ({EVAL})", "labels")
    some = lambda n: F.array_repeat(F.lit("x"), F.col(n).cast("int"))
    out = x.select("id", rules.fuse(some("nh"), some("ns"), F.col("ps"), F.col("pf")).alias("verdict"), rules.rules_only(some("nh"), some("ns")).alias("rules_only"), rules.risk(F.col("ps"), F.col("pf")).alias("risk"))
    return rounded(out, "risk")


@query(f"WITH {_I} SELECT id, md5(concat('CHANNEL: ', channel, chr(10), 'SENDER: ', coalesce(sender, 'unknown'), ' (', CASE WHEN sender LIKE 'VK%' THEN 'registered' WHEN sender LIKE '+%' THEN 'unregistered' ELSE 'unknown' END, ')', chr(10), 'RULE_SIGNALS: [', CASE WHEN id % 2 = 0 THEN 'apk_link, threat_lexicon' ELSE '' END, ']', chr(10), 'MESSAGE:', chr(10), text)) AS digest FROM i")
def prompt_render(spark, sf):
    signals = F.when(F.col("id") % 2 == 0, F.array(F.lit("threat_lexicon"), F.lit("apk_link"), F.lit("apk_link"))).otherwise(F.array().cast("array<string>"))
    return _items(spark, sf).select("id", F.md5(messages.user_message(F.col("channel"), F.col("sender"), T.sender_status(F.col("sender")), signals, F.col("text"))).alias("digest"))


@query(f"WITH {_I} SELECT id, channel, sender, md5(text) AS digest FROM i")
def prompt_parse(spark, sf):
    rows = _items(spark, sf).select("id", messages.parse_user_message(messages.user_message(F.col("channel"), F.col("sender"), T.sender_status(F.col("sender")), F.array(F.lit("a"), F.lit("b")), F.col("text"))).alias("m"))
    return rows.select("id", "m.channel", "m.sender", F.md5("m.text").alias("digest"))


@query(f"WITH {_I}, r AS (SELECT id, verdict, category, id % 4 AS k, substr(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 1, 20) AS q FROM i) SELECT id, CASE WHEN k = 3 THEN 'UNKNOWN' ELSE verdict END AS verdict, CASE WHEN k = 3 OR k = 2 THEN NULL ELSE category END AS category, k = 0 AS json_valid, k <> 3 AS json_parsed FROM r")
def reply_parse(spark, sf):
    """Replies strict (k=0), fenced (1), with an unknown category (2) and without JSON (3)."""
    k = F.col("id") % 4
    quote = F.substring(F.regexp_replace("text", "[^A-Za-z ]", ""), 1, 20)
    target = messages.target_json(F.col("verdict"), F.when(k == 2, "nothing_known").otherwise(F.col("category")), F.array(F.struct(quote.alias("quote"), F.lit("apk_link").alias("reason"))))
    raw = F.when(k == 1, F.concat(F.lit("```json\n"), target, F.lit("\n```"))).when(k == 3, "no verdict today").otherwise(target)
    return _items(spark, sf).select("id", messages.parse_reply(raw).alias("r")).select("id", "r.verdict", "r.category", "r.json_valid", "r.json_parsed")


@query(f"WITH {_I} SELECT id, array_to_string(list_filter([CASE WHEN text = '' THEN 'empty_text' END, CASE WHEN id % 10 = 0 THEN 'bad_verdict' END, CASE WHEN id % 10 = 0 AND verdict = 'SAFE' OR id % 7 = 0 THEN 'bad_category' END, CASE WHEN id % 9 = 0 THEN 'bad_language' END, CASE WHEN verdict = 'SAFE' AND id % 10 <> 0 AND id % 3 = 0 THEN 'safe_with_flags' END, CASE WHEN (verdict <> 'SAFE' OR id % 10 = 0) AND id % 3 <> 0 THEN 'missing_flags' END, CASE WHEN id % 3 = 0 AND id % 6 = 0 THEN 'ungrounded_quote' END], lambda x: x IS NOT NULL), ',') AS problems FROM i")
def item_problems(spark, sf):
    i = F.col("id")
    flags = F.when(i % 3 == 0, F.array(F.struct(F.when(i % 6 == 0, "\u0001").otherwise(F.substring("text", 1, 5)).alias("quote"), F.lit("apk_link").alias("reason")))).otherwise(F.array().cast(messages.FLAGS))
    verdict, category = F.when(i % 10 == 0, "MAYBE").otherwise(F.col("verdict")), F.when(i % 7 == 0, "none").otherwise(F.col("category"))
    found = messages.problems(F.col("text"), verdict, category, F.col("channel"), F.when(i % 9 == 0, "xx").otherwise(F.col("language")), flags)
    return _items(spark, sf).select("id", F.array_join(found, ",").alias("problems"))


@query(f"WITH {_I} SELECT id, verdict, category FROM i WHERE {_TIDY.format(t='text')} <> '' AND (verdict = 'SAFE' OR id % 3 = 0)")
def valid_items(spark, sf):
    flags = F.when(F.col("id") % 3 == 0, F.array(F.struct(F.regexp_extract("text", r"\S+", 0).alias("quote"), F.lit("apk_link").alias("reason")))).otherwise(F.array().cast(messages.FLAGS))
    return messages.valid_items(_items(spark, sf).withColumn("red_flags", flags)).select("id", "verdict", "category")


@query(f"WITH {_I} SELECT id, CASE WHEN language = 'en' THEN 'en' ELSE 'hinglish' END AS language FROM i")
def relabelled_language(spark, sf):
    return _items(spark, sf).select("id", messages.relabelled_language(F.col("language"), F.col("text")).alias("language"))


@query(f"WITH {_I} SELECT id, (verdict = 'SAFE' AND category IN ('genuine_otp', 'transaction_alert')) AS narrow FROM i")
def hard_negatives(spark, sf):
    return _items(spark, sf).select("id", messages.hard_negative(F.col("verdict"), F.col("category")).alias("narrow"))


@query(r"WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT conv_id, count(*) AS n, md5(string_agg(concat(role, ':', text), chr(10) ORDER BY turn, role, text)) AS digest FROM t GROUP BY conv_id")
def chat_rows(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.count("*").alias("n"), turns.alias("t"))
    return rows.select("conv_id", "n", F.md5(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")).alias("digest"))


@query()
def redaction_counts(spark, sf):
    """Masks put into every document, and digit runs left."""
    rows = _docs(spark, sf).select(F.col("doc_id").alias("id"), "text", F.lit("sms").alias("channel"), "source")
    done, _ = redact.redact_records(rows, names=("idiot",))
    return done.select("id", "digits_left", F.aggregate(F.map_values("counts"), F.lit(0), lambda a, x: a + x).alias("n_masks"))


_WORD = "CASE verdict WHEN 'SCAM' THEN 'scam' WHEN 'SUSPICIOUS' THEN 'careful' ELSE 'normal' END"
_SAID = f"CASE WHEN id % 6 = 0 THEN concat('This is a ', {_WORD}, ' message.') WHEN id % 6 = 1 THEN concat('There is no ', {_WORD}, ' here.') WHEN id % 6 = 2 THEN 'Looks fine. Call 99123 now.' WHEN id % 6 = 3 THEN concat('One. Two. Three. Four ', {_WORD}, '.') WHEN id % 6 = 4 THEN concat('Do not reply, ', {_WORD}, ' it is, see scam.zip.') ELSE concat(repeat('word ', 60), {_WORD}) END"
_NOT_IN = "CASE WHEN contains(lower(text), 'scam.zip') THEN '' ELSE 'foreign_url' END"


@query(
    f"WITH {_I}, k AS (SELECT id, id % 6 AS k, verdict, text FROM i), p AS (SELECT id, CASE k WHEN 0 THEN '' WHEN 1 THEN 'negated_verdict_word' WHEN 2 THEN concat('verdict_word_missing', CASE WHEN regexp_matches(text, '(^|[^0-9])99123($|[^0-9])') THEN '' ELSE ',foreign_number' END) "
    f"WHEN 3 THEN 'too_many_sentences' WHEN 4 THEN concat(CASE WHEN verdict = 'SUSPICIOUS' THEN 'other_verdict_word,' ELSE '' END, {_NOT_IN}) ELSE 'too_many_words' END AS problems FROM k) SELECT id, problems FROM p"
)
def explanation_checks(spark, sf):
    said = F.expr(_SAID)
    return _items(spark, sf).select("id", F.array_join(messages.explanation_problems(said, F.col("verdict"), "en", F.col("text")), ",").alias("problems"))
