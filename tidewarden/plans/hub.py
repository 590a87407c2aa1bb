"""Queries of the pool, the explanations, the systems and the file sources."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import text as T
from ..functions.vocab import scan_entries
from ..operators import lookalike, messages, metrics, ordered, pool, redact, rules, split
from ..sources import jsonl, predictions
from ..sources.keyed import KeyedStore
from ..sources.shared import new_path
from . import evaluation
from .frames import EVAL, ITEMS, duck, view
from .text import DEMO

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_I = f"i AS ({duck(ITEMS)})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _items(spark, sf):
    return view(spark, sf, ITEMS, "labels", "documents")


_NONE = "array<string>"


# -- probabilities, flags, acceptance ------------------------------------------------
@query(f"WITH {_I}, p AS (SELECT id, (id % 7 + 1) / 20.0 AS a, (id % 5 + 1) / 20.0 AS b, (id % 3) / 20.0 AS c FROM i) SELECT id, round(a / (a + b + c), 6) AS p_scam, round(b / (a + b + c), 6) AS p_safe FROM p WHERE id % 11 <> 0")
def label_probabilities(spark, sf):
    """From the tokens of a reply whose verdict is one token; every eleventh reply has no verdict."""
    i = F.col("id")
    word = {"SCAM": (i % 7 + 1) / 20, "SAFE": (i % 5 + 1) / 20, "SUSPICIOUS": (i % 3) / 20}
    top = F.filter(F.array(*[F.struct(F.lit(k).alias("token"), F.log(p).alias("logprob")) for k, p in word.items()]), lambda x: x["logprob"].isNotNull())
    none = F.array().cast("array<struct<token:string,logprob:double>>")
    token = lambda text, p, others: F.struct(text.alias("token"), p.alias("logprob"), others.alias("top"))
    first = F.when(i % 11 == 0, F.lit("no verdict")).otherwise(F.lit('{"verdict": "'))
    reply = F.array(token(first, F.lit(0.0), none), token(F.lit("SCAM"), F.log(word["SCAM"]), top), token(F.lit('"}'), F.lit(0.0), none))
    rows = _items(spark, sf).select("id", rules.label_probabilities(reply).alias("p")).filter("p is not null")
    return rows.select("id", F.round("p.p_scam", 6).alias("p_scam"), F.round("p.p_safe", 6).alias("p_safe"))


#: All but A-Z, a-z, blank and dot; a negated class takes Java many times as long.
_UNPLAIN = r"[\x00-\x1F!-\-/-@\[-`{-\x{10FFFF}]"


@query(f"WITH {_I}, k AS (SELECT id, id % 5 AS k, text FROM i) SELECT id, CASE k WHEN 0 THEN 2 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 1 ELSE NULL END AS n_flags FROM k WHERE length(trim(text)) > 12 AND NOT contains(text, chr(1))")
def clean_flags(spark, sf):
    """Flags kept per item: two good ones and a repeated one (0), a quote not in the text (1), an unknown reason (2), one that does not fit and one that does (3), none (4)."""
    k = F.col("id") % 5
    quote = F.substring("text", 1, 5)
    flag = lambda q, r: F.struct(q.alias("quote"), F.lit(r).alias("reason"))
    sets = {0: [flag(quote, "asks_payment"), flag(quote, "threat_or_arrest"), flag(quote, "asks_payment")], 1: [flag(F.lit("\x01\x01"), "asks_payment")], 2: [flag(quote, "none_such")], 3: [flag(quote, "apk_link"), flag(quote, "secrecy_request")]}
    flags = F.coalesce(*[F.when(k == n, F.array(*own)) for n, own in sets.items()], F.array().cast(messages.FLAGS))
    plain = T.with_computed(_items(spark, sf).select("id", "text"), text=F.regexp_replace("text", _UNPLAIN, "x"))
    rows = T.with_computed(plain, text=T.normal_text(F.col("text"))).filter(F.length(F.trim("text")) > 12)
    return rows.select("id", F.nullif(F.size(messages.clean_flags(flags, F.col("text"))), F.lit(-1)).alias("n_flags"))


@query(
    f"WITH {_I} SELECT id, length(text) BETWEEN 8 AND 700 AND NOT regexp_matches(text, '\\[[^\\[\\]]{{0,40}}\\]|<[A-Za-z ]{{2,30}}>') AND CASE WHEN verdict = 'SAFE' THEN id % 3 = 0 OR category = 'personal' WHEN verdict = 'SUSPICIOUS' THEN id % 2 = 0 AND id % 5 <> 0 ELSE id % 2 = 0 END AS accepted, "
    "length(text) BETWEEN 8 AND 500 AND id % 5 <> 0 AS call_accepted FROM i"
)
def acceptance(spark, sf):
    i, none = F.col("id"), F.array().cast(_NONE)
    flags = F.when(i % 2 == 0, F.array(F.struct(F.lit("x").alias("quote"), F.lit("apk_link").alias("reason"))))
    status, soft = T.sender_status(F.col("sender")), F.when(i % 5 == 0, F.array(F.lit("threat_lexicon"))).otherwise(F.array(F.lit("unregistered_sender")))
    good = messages.acceptable(F.col("text"), F.col("verdict"), F.col("category"), status, flags, none, none, soft)
    return _items(spark, sf).select("id", good.alias("accepted"), messages.acceptable_call(F.col("text"), none, none, soft).alias("call_accepted"))


def _words(kind: str) -> str:
    return " OR ".join([f"contains(t, '{w}')" for w in messages.SAFE_WORDS[kind]] + [rf"regexp_matches(t, '(^|[^\p{{L}}\p{{N}}_]){w}($|[^\p{{L}}\p{{N}}_])')" for w in messages.SAFE_WHOLE_WORDS.get(kind, ())])


_KINDS = [k for k in messages.SAFE_WORDS if k != "genuine_otp"]


@query(
    f"WITH {_I}, t AS (SELECT id, category, sender, lower(text) AS t FROM i WHERE verdict = 'SAFE'), f AS (SELECT *, " + ", ".join(f"({_words(k)}) AS {k}" for k in _KINDS) + " FROM t) "
    "SELECT id, CASE WHEN category = 'personal' THEN CASE WHEN coalesce(sender, '') NOT LIKE 'VK%' THEN 'personal' END " + " ".join(f"WHEN category = '{k}' AND {k} THEN '{k}'" for k in _KINDS) + " " + " ".join(f"WHEN {k} THEN '{k}'" for k in _KINDS) + " END AS category FROM f"
)
def safe_category(spark, sf):
    rows = _items(spark, sf).filter("verdict = 'SAFE'")
    return rows.select("id", messages.safe_category(F.col("category"), F.col("text"), T.sender_status(F.col("sender"))).alias("category"))


@query()
def filled_placeholders(spark, sf):
    """Items with placeholders put in, then filled (random draws are hashes; compared by brute force in the tests)."""
    rows = _items(spark, sf).withColumn("text", F.concat(F.lit("code <OTP> for account ending <ACCT>, ref no. <ACCT>. "), "text"))
    flags = F.array(F.struct(F.lit("code <OTP>").alias("quote"), F.lit("asks_otp_or_pin").alias("reason")), F.struct(F.lit("OTP> for").alias("quote"), F.lit("asks_otp_or_pin").alias("reason")))
    return split.fill_placeholders(rows.withColumn("red_flags", flags)).select("id", "text", F.size("red_flags").alias("n_flags"))


@query()
def redaction_totals(spark, sf):
    """Masks of every kind over all documents (the masks are tested case by case)."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.lit("sms").alias("channel"), "source")
    done, _ = redact.redact_records(rows, names=("idiot",))
    return redact.redaction_report(done).filter("id is null").select("mask", "n")


# -- scrubbing, templates, explanations ----------------------------------------------
@query(f"WITH {_I} SELECT id, concat(verdict, '|', CAST(id % 3 AS VARCHAR), '|', CASE WHEN id % 2 = 0 THEN 'k=v' ELSE '' END) AS kept, 2 AS n_columns FROM i")
def scrubbed(spark, sf):
    """Message content gone at every depth; what is left is spelled out."""
    deep = F.struct(F.col("text"), F.col("verdict"), F.array(F.struct(F.col("text").alias("quote"), (F.col("id") % 3).alias("n"))).alias("list"), F.when(F.col("id") % 2 == 0, F.create_map(F.lit("k"), F.lit("v"), F.lit("Prompt"), F.col("text"))).otherwise(F.create_map(F.lit("text"), F.col("text"))).alias("map"))
    clean = messages.scrub(_items(spark, sf).select("id", "text", "sender", deep.alias("deep")))
    pairs = F.array_join(F.transform(F.map_entries("deep.map"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return clean.select("id", F.concat_ws("|", "deep.verdict", F.get("deep.list", F.lit(0))["n"].cast("string"), pairs).alias("kept"), F.lit(len(clean.columns)).alias("n_columns"))


_TEMPLATES = [
    ("en", "SCAM", "headline", "Someone wants to trick you"), ("en", "SCAM", "default", "Do nothing. Call {name}."), ("en", "SCAM", "otp_phishing", "Share no code. Call {name}."), ("en", "SUSPICIOUS", "headline", "Something is odd here"), ("en", "SUSPICIOUS", "default", "Wait."),
    ("en", "SAFE", "headline", "Nothing odd here"), ("en", "SAFE", "default", "No sign of trouble."), ("en", "UNKNOWN", "headline", "Not known"), ("en", "UNKNOWN", "default", "Ask {name}."),
    ("hi", "SCAM", "headline", "यह ठगी का संदेश है"), ("hi", "SCAM", "default", "कुछ न करें।"), ("hi", "UNKNOWN", "headline", "पता नहीं"), ("hi", "UNKNOWN", "default", "पूछें।"),
]
_T = "t AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in _TEMPLATES) + ") AS v(language, verdict, category, sentence))"


def _template_rows(spark):
    return spark.createDataFrame(_TEMPLATES, "language string, verdict string, category string, sentence string")


@query(
    f"WITH {_I}, {_T}, k AS (SELECT i.id, i.category, CASE WHEN language = 'hi' THEN 'hi' ELSE 'en' END AS l, verdict AS v0 FROM i), q AS (SELECT k.*, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.language = l AND t.verdict = v0) THEN v0 ELSE 'UNKNOWN' END AS v FROM k) "
    "SELECT q.id, concat(h.sentence, '. ', replace(coalesce(o.sentence, d.sentence), '{name}', 'Ann')) AS explanation FROM q LEFT JOIN t h ON h.language = l AND h.verdict = v AND h.category = 'headline' LEFT JOIN t d ON d.language = l AND d.verdict = v AND d.category = 'default' LEFT JOIN t o ON o.language = l AND o.verdict = v AND o.category = q.category"
)
def template_explanations(spark, sf):
    """The fixed sentence of every item; hinglish falls back to English, a verdict without Hindi rows to UNKNOWN."""
    return messages.with_template(_items(spark, sf).withColumn("name", F.lit("Ann")), _template_rows(spark)).select("id", "explanation")


@query(
    f"WITH {_I}, k AS (SELECT id, verdict, id % 5 AS k FROM i), w AS (SELECT *, CASE verdict WHEN 'SCAM' THEN 'scam' ELSE 'careful' END AS w FROM k) "
    "SELECT id, CASE WHEN verdict = 'SAFE' THEN 'template' WHEN k = 0 THEN 'first' WHEN k = 1 THEN 'second' WHEN k = 2 THEN 'template' WHEN k = 3 THEN 'template' ELSE 'second' END AS origin FROM w"
)
def explained(spark, sf):
    """Which draft explains an item: good at once (0), denied then good (1), model down (2), bad twice (3), empty then good (4)."""
    k = F.col("id") % 5
    hindi, scam = F.col("language") == "hi", F.col("verdict") == "SCAM"
    word = F.when(hindi, F.when(scam, "स्कैम").otherwise("सावधान")).otherwise(F.when(scam, "scam").otherwise("careful"))
    good = lambda n: F.concat(F.lit(f"Draft {n}: "), word, F.lit("."))
    bad = F.when(hindi, F.concat(F.lit("यह "), word, F.lit(" नहीं है।"))).otherwise(F.concat(F.lit("This is never "), word, F.lit(".")))
    ordinal = lambda n: F.replace(good(n), F.lit(str(n)), F.lit("one" if n == 1 else "two"))  # noqa: E731  no numbers that the message lacks
    first = lambda df: df.withColumn("draft", F.when(k == 0, ordinal(1)).when(k == 1, bad).when(k == 2, None).when(k == 3, bad).otherwise(F.lit("")))
    second = lambda df: df.withColumn("draft", F.when(k.isin(1, 4, 2), ordinal(2)).otherwise(bad))
    rows = _items(spark, sf).withColumn("name", F.lit("Ann"))
    done = messages.explained(rows, _template_rows(spark), [first, second])
    return done.select("id", F.when(F.col("explanation").startswith("Draft one"), "first").when(F.col("explanation").startswith("Draft two"), "second").otherwise("template").alias("origin"))


# -- the pool --------------------------------------------------------------------------
_L = "l AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'family_real' WHEN id % 3 = 1 THEN 'own_inbox' ELSE 'public_report' END AS source, id % 10 = 0 AS is_test, 'SCAM' AS verdict FROM i WHERE id % 7 <> 0)"


def _labels(items):
    source = F.when(F.col("id") % 3 == 0, "family_real").when(F.col("id") % 3 == 1, "own_inbox").otherwise("public_report")
    flags = F.array(F.struct(F.when(F.col("id") % 20 == 0, "\x01").otherwise(F.left(T.tidy(F.col("text")), F.lit(3))).alias("quote"), F.lit("apk_link").alias("reason")))
    return items.filter("id % 7 <> 0").select("id", source.alias("source"), (F.col("id") % 10 == 0).alias("is_test"), F.lit("SCAM").alias("verdict"), flags.alias("red_flags"))


@query(f"WITH {_I}, {_L} SELECT l.id, l.verdict, CAST(l.id AS VARCHAR) AS seed_group FROM l WHERE source <> 'public_report' AND NOT is_test AND l.id % 4 <> 0")
def labelled_items(spark, sf):
    """Real, labelled items that are not test items; one item in four is of another source."""
    items = _items(spark, sf)
    raw = items.drop("seed_group").withColumn("source", F.when(F.col("id") % 4 == 0, "forum").otherwise("own_inbox"))
    return pool.labelled(raw, _labels(items)).select("id", "verdict", "seed_group")


@query(f"WITH {_I}, {_L} SELECT l.id, CASE WHEN l.id % 8 = 6 THEN 'no_item' WHEN source = 'public_report' OR l.id % 4 = 0 THEN 'not_real' END AS problem FROM l WHERE is_test AND (l.id % 8 = 6 OR source = 'public_report' OR l.id % 4 = 0)")
def frozen_problems(spark, sf):
    """Test labels that cannot be frozen; items with ids of remainder 6 by 8 are missing."""
    items = _items(spark, sf)
    raw = items.filter("id % 8 <> 6").withColumn("source", F.when(F.col("id") % 4 == 0, "forum").otherwise("own_inbox"))
    return pool.frozen_items(raw, _labels(items))[1]


@query(f"WITH {_I} SELECT part, count(*) AS n, sum(id) AS ids FROM (SELECT 0 AS part, id FROM i WHERE id % 2 = 0 UNION ALL SELECT 1, id FROM i UNION ALL SELECT 2, id FROM i WHERE id % 5 = 0) GROUP BY part")
def pool_union(spark, sf):
    items = _items(spark, sf)
    both = pool.pool(items.filter("id % 2 = 0"), items.drop("sender"), items.filter("id % 5 = 0"))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"WITH {_I} SELECT id, regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_\\x{{0900}}-\\x{{097F}}])(idiot|moron|worthless)($|[^\\p{{L}}\\p{{N}}_\\x{{0900}}-\\x{{097F}}])') AS threat, true AS no_sender FROM i")
def without_sender(spark, sf):
    """Items as if shared without a sender: the sender's signal cannot fire, those of the text still do."""
    rows = pool.without_sender(_items(spark, sf), DEMO)
    bare = F.col("sender").isNull() & ~F.array_contains("signals", "unregistered_sender") & F.contains("user_message", F.lit("SENDER: unknown (unknown)"))
    return rows.select("id", F.array_contains("signals", "threat_lexicon").alias("threat"), bare.alias("no_sender"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS digest FROM pages")
def html_escaped(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.md5(pool.html_escaped(F.col("html"))).alias("digest"))


@query(
    f"WITH h AS ({evaluation.ORACLE['threshold_high']}), l AS ({evaluation.ORACLE['threshold_low']}) SELECT 'both' AS given, h.value AS t_high, l.value AS t_low, true AS calibrated FROM h, l "
    "UNION ALL SELECT 'high', h.value, 0.35, false FROM h UNION ALL SELECT 'none', 0.8, 0.35, false UNION ALL SELECT 'settings', 0.7, 0.2, true"
)
def thresholds(spark, sf):
    """The thresholds found on the labelled cases, written to a file and loaded; a file of one of them, no file, settings."""
    folder = new_path(spark, "thresholds")
    found = evaluation.threshold_high(spark, sf).select(F.col("value").alias("T_HIGH")).join(evaluation.threshold_low(spark, sf).select(F.col("value").alias("T_LOW")))  # one row each
    found = found.persist()
    for name, kept in (("both", ["T_HIGH", "T_LOW"]), ("high", ["T_HIGH"])):
        found.select(F.to_json(F.struct(*kept)).alias("value")).coalesce(1).write.text(f"{folder}/{name}")
    found.unpersist()
    load = pool.load_thresholds
    rows = [("both", *load(spark, f"{folder}/both")), ("high", *load(spark, f"{folder}/high")), ("none", *load(spark, f"{folder}/missing")), ("settings", *load(spark, None, 0.7, 0.2))]
    return spark.createDataFrame(rows, "given string, t_high double, t_low double, calibrated boolean")


# -- systems and nodes --------------------------------------------------------------------
@query(f"WITH {_I} SELECT id, CASE WHEN id % 6 = 0 THEN 'UNKNOWN' ELSE verdict END AS pred_verdict, CASE WHEN id % 6 = 0 THEN NULL ELSE category END AS pred_category, CASE WHEN id % 6 = 0 THEN NULL ELSE true END AS json_valid FROM i")
def prompted_system(spark, sf):
    """A chat system whose model repeats the gold and gives no JSON for every sixth item."""

    def complete(lists):
        out = []
        for turns in lists:
            said = dict(part.split("=", 1) for part in turns[-1]["content"].rsplit("MESSAGE:\n", 1)[1].split("|")[:3])
            out.append("sorry" if int(said["id"]) % 6 == 0 else json.dumps({"verdict": said["v"], "category": said["c"], "red_flags": []}))
        return out

    rows = _items(spark, sf).withColumns({"text": F.concat(F.lit("id="), "id", F.lit("|v="), "verdict", F.lit("|c="), "category"), "signals": F.array().cast(_NONE)})
    done = scoring.prompted(complete, "Judge the message.")(rows)
    return done.select("id", "pred_verdict", "pred_category", F.when(F.col("json_valid"), F.lit(True)).alias("json_valid"))


@query(f"WITH {_I}, k AS (SELECT id, id % 4 AS part FROM i) SELECT part, count(*) AS n, CASE WHEN part = 3 THEN count(*) ELSE 0 END AS n_failed, CASE WHEN part = 3 THEN 'UNKNOWN' ELSE 'SAFE' END AS verdict FROM k GROUP BY part")
def node_errors(spark, sf):
    """A stage that fails on one part of the rows: those get the fallback's verdict and the error's type, all get a timing."""

    def work(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["part"] == 3).any():
            raise ValueError("down")
        return pd.DataFrame({"verdict": "SAFE"}, index=batch.index)

    rows = _items(spark, sf).select("id", (F.col("id") % 4).cast("int").alias("part"))
    stage = scoring.node("judge", work, "verdict string", lambda b: pd.DataFrame({"verdict": "UNKNOWN"}, index=b.index))
    done = [stage(rows.filter(F.col("part") == k)) for k in range(4)]
    every = done[0].unionByName(done[1]).unionByName(done[2]).unionByName(done[3]).filter(F.map_contains_key("timings_ms", F.lit("judge")))
    return every.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.array_contains("errors", "judge:ValueError")).alias("n_failed"), F.max("verdict").alias("verdict"))


@query(f"WITH {_I}, k AS (SELECT id, id % 3 AS k, length(text) > 4 AS long FROM i) SELECT id, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 1.0 ELSE 0.5 END AS rate FROM k WHERE long")
def grounding(spark, sf):
    quote = F.left("text", F.lit(4))
    flag = lambda q: F.struct(q.alias("quote"), F.lit("apk_link").alias("reason"))
    k = F.col("id") % 3
    flags = F.when(k == 0, F.array().cast(messages.FLAGS)).when(k == 1, F.array(flag(quote))).otherwise(F.array(flag(quote), flag(F.lit("\x01"))))
    return _items(spark, sf).filter(F.length("text") > 4).select("id", rules.ground_rate(flags, F.col("text")).alias("rate"))


# -- files -------------------------------------------------------------------------------------
@query(f"WITH {_I} SELECT id, channel, sender, verdict, category, md5(text) AS digest FROM (SELECT CAST(id AS VARCHAR) AS id, channel, sender, verdict, category, text FROM i)")
def split_file_items(spark, sf):
    """Items written as a split file of messages and meta, and read back."""
    rows = _items(spark, sf)
    user = messages.user_message(F.col("channel"), F.col("sender"), T.sender_status(F.col("sender")), F.array().cast(_NONE), F.col("text"))
    target = messages.target_json(F.col("verdict"), F.col("category"), F.array().cast(messages.FLAGS))
    path = new_path(spark, "split")
    jsonl.write_split(rows.select(messages.chat(F.lit("Judge."), user, target).alias("messages"), F.struct("id").alias("meta")), path, "dev", key="meta")
    back = messages.split_items(spark.read.schema("messages array<struct<role: string, content: string>>, meta struct<id: long>").json(f"{path}/dev"))
    return back.select("id", "channel", "sender", F.col("gold_verdict").alias("verdict"), F.col("gold_category").alias("category"), F.md5("text").alias("digest"))


@query("SELECT count(*) AS n_rows, count_if(item_id % 4 = 0) AS n_bad FROM benchmark")
def batch_scan(spark, sf):
    """JSON lines of which every fourth is broken: good rows and bad ones counted apart; a review file is not read."""
    rows = spark.read.parquet(f"{sf}/benchmark.parquet")
    line = F.when(F.col("item_id") % 4 == 0, F.lit('{"item_id": oops')).otherwise(F.to_json(F.struct("item_id", "text")))
    path = new_path(spark, "batches")
    written = rows.select(line.alias("value")).repartition(3)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs  # Spark names its files itself; the scan goes by names
    written.write.text(path)
    root = jvm.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for n, f in enumerate(x for x in store.listStatus(root) if x.getPath().getName().startswith("part-")):
        store.rename(f.getPath(), jvm.Path(root, f"batch_{n}.jsonl"))
    written.limit(1).coalesce(1).write.text(f"{path}/more")
    good, bad = jsonl.read_batches(spark, path, "item_id long, text string")
    return good.agg((F.count("*") + bad.count()).alias("n_rows"), F.lit(bad.count()).alias("n_bad"))


@query("SELECT true AS same_in_any_order, true AS differs_by_a_row, true AS differs_by_a_copy, 'locked' AS test_split")
def split_digests(spark, sf):
    """A digest does not see the order of rows and sees every row; the frozen split is written once."""
    rows = spark.read.parquet(f"{sf}/benchmark.parquet")
    d = jsonl.digest(rows, "item_id")
    path = new_path(spark, "frozen")
    lock = jsonl.freeze_split(rows, path, {}, key="item_id")
    try:
        jsonl.freeze_split(rows, path, lock, key="item_id")
        state = "written twice"
    except ValueError:
        state = "locked" if lock["test"]["sha256"] == d else "other digest"
    facts = (jsonl.digest(rows.repartition(5).orderBy("text"), "item_id") == d, jsonl.digest(rows.filter("item_id <> 1"), "item_id") != d, jsonl.digest(rows.unionByName(rows.filter("item_id = 1")), "item_id") != d, state)
    return spark.createDataFrame([facts], "same_in_any_order boolean, differs_by_a_row boolean, differs_by_a_copy boolean, test_split string")


_RUNS = "SELECT concat('run-', CAST(id % 7 AS STRING), CASE WHEN id % 7 = 3 THEN '-crashed' ELSE '' END) AS run, CAST(id % 3 + 1 AS INT) AS epoch, concat('d', CAST(id % 7 % 4 AS STRING)) AS digest, round(avg(CASE WHEN pred_verdict = gold_verdict THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS macro_f1, round(avg(CASE WHEN score >= 500 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS recall FROM ({e}) e GROUP BY 1, 2, 3"
_R = f"r AS ({duck(_RUNS.format(e=EVAL))})"


def _runs(spark, sf):
    """Epochs of seven runs, one of them crashed: shares over the labelled rows that fall to them."""
    return view(spark, sf, _RUNS.format(e=EVAL), "labels").withColumns({"macro_f1": F.col("macro_f1").cast("double"), "recall": F.col("recall").cast("double")})


@query(f"WITH {_R} SELECT run, epoch, CAST(macro_f1 AS DOUBLE) AS macro_f1, digest FROM r WHERE run NOT LIKE '%crashed%'")
def run_scan(spark, sf):
    """Every run's metrics and configuration written to a folder of its own and read back; the crashed one is left out."""
    path = new_path(spark, "runs")
    epochs = F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("epoch", "macro_f1"))).alias("epochs")))
    runs = _runs(spark, sf).groupBy("run").agg(epochs.alias("metrics"), F.to_json(F.struct(F.max("digest").alias("dev_sha256"))).alias("config")).collect()  # a row a run
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in runs:
        for name, body in (("metrics", r.metrics), ("config", r.config)):
            out = store.create(hadoop.Path(f"{path}/{r.run}/{name}.json"))
            out.write(bytearray(body, "utf-8"))
            out.close()
    found = jsonl.read_runs(spark, path).select("run", F.col("epoch").cast("int").alias("epoch"), "macro_f1")
    return found.join(jsonl.read_run_configs(spark, path, "dev_sha256 string").select("run", F.col("dev_sha256").alias("digest")), "run").select("run", "epoch", "macro_f1", "digest")


_USE = "SELECT event_id, ts, event_type AS kind, (event_id % 90 + 1) * 1000 AS tokens, CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 0.5 ELSE 1.5 END AS rate FROM events"


@query(
    f"WITH u AS ({_USE}), b AS (SELECT date_trunc('day', min(ts)) AS lo FROM events), p AS (SELECT CAST(floor((epoch(ts) - epoch(lo)) / 1209600) AS BIGINT) AS page, kind, tokens, rate FROM u, b) "
    "SELECT page, kind, sum(tokens) AS tokens, round(sum(tokens * rate / 1e6), 6) AS usd, count_if(rate IS NULL) AS unpriced FROM p GROUP BY page, kind"
)
def billing_pages(spark, sf):
    """All usage in pages of fourteen days."""
    use = spark.read.parquet(f"{sf}/events.parquet")
    lo = use.agg(F.date_trunc("day", F.min("ts")).alias("lo")).first()["lo"]
    rate = F.when(F.col("event_id") % 6 == 0, None).when(F.col("event_id") % 2 == 0, 0.5).otherwise(1.5)
    rows = use.select(F.col("ts").alias("at"), F.col("event_type").alias("kind"), ((F.col("event_id") % 90 + 1) * 1000).alias("tokens"), rate.alias("rate"))
    until = use.agg(F.date_add(F.to_date(F.max("ts")), 1).alias("u")).first()["u"]
    return metrics.billing_windows(rows, str(lo), str(until)).select("page", "kind", "tokens", F.round("usd", 6).alias("usd"), "unpriced")


@query(
    f"WITH {_R}, t AS (SELECT digest, run, epoch FROM r QUALIFY row_number() OVER (PARTITION BY digest ORDER BY macro_f1 DESC, recall DESC, run, epoch) = 1), f AS (SELECT digest, min(run) AS first FROM r GROUP BY digest) "
    "SELECT t.digest, t.run AS best_run, t.epoch AS best_epoch, t.digest = 'd1' AS is_current, CAST(row_number() OVER (ORDER BY t.digest = 'd1', f.first) AS INT) AS place FROM t JOIN f ON t.digest = f.digest"
)
def runs_by_digest(spark, sf):
    return metrics.runs_by_digest(_runs(spark, sf), "d1").select("digest", "best_run", "best_epoch", "is_current", "place")


@query(f"WITH e AS ({duck(EVAL)}), o AS (SELECT id, pred_verdict, score, row_number() OVER (ORDER BY id) - 1 AS ordinal FROM e) SELECT id, CASE WHEN id % 10 = 0 THEN 'SAFE' ELSE pred_verdict END AS pred_verdict, score, ordinal FROM o")
def prediction_cache(spark, sf):
    """Predictions written, a tenth of them again, and read back by id in the order asked for: the last row of an id counts."""
    rows = view(spark, sf, EVAL, "labels").select("id", "pred_verdict", "score", F.lit("never written").alias("text"))
    folder = new_path(spark, "predictions")
    predictions.write_predictions(rows, folder)
    predictions.write_predictions(rows.filter("id % 10 = 0").withColumn("pred_verdict", F.lit("SAFE")), folder)
    cache = predictions.last_of(predictions.read_predictions(spark, folder, "id long, pred_verdict string, score long"))
    return predictions.for_ids(cache, _numbered(rows.select("id"))).select("id", "pred_verdict", "score", "ordinal")


def _numbered(ids):
    """Ids with their place in order, from 0."""
    each = ordered.running(ids.groupBy("id").agg(F.count("*").alias("n")), "id", ["n"])
    return each.select("id", (F.col("_to_n") - 1).alias("ordinal"))


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id")
def event_snapshot(spark, sf):
    """Events put into a keyed store by user, in three batches out of order and one of them twice: the latest of each."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    store = KeyedStore(spark, new_path(spark, "store"), "user_id", "ts", most_files=2)
    for n in (2, 0, 2, 1):
        store.upsert(events.filter(F.col("event_id") % 3 == n).select("user_id", "ts", "event_id"), n)
    return store.read().select("user_id", "ts")


_HOSTS = "SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS name FROM pages"


@query(f"WITH n AS ({_HOSTS}), d AS (SELECT name AS domain FROM n WHERE name LIKE '%.com') SELECT name, domain, CAST(levenshtein(name, domain) AS INT) AS distance FROM n, d WHERE levenshtein(name, domain) BETWEEN 1 AND CASE WHEN length(split_part(domain, '.', 1)) <= 4 THEN 1 ELSE 2 END")
def lookalike_hosts(spark, sf):
    """Hosts of all pages close to one of a list of domains that is read from a file."""
    hosts = spark.read.parquet(f"{sf}/pages.parquet").select(T.host(F.col("url")).alias("name")).distinct()
    listed = new_path(spark, "domains")
    hosts.filter(F.col("name").endswith(".com")).select(F.concat("name", F.lit("  # ours")).alias("value")).write.text(listed)
    return lookalike.lookalikes(hosts, scan_entries(spark, listed), "name", "entry").withColumnRenamed("entry", "domain")


@query("SELECT event_id, CASE WHEN CAST(ts + INTERVAL 330 MINUTE AS DATE) = DATE '2024-01-15' THEN strftime(ts + INTERVAL 330 MINUTE, '%H:%M') ELSE strftime(ts + INTERVAL 330 MINUTE, '%b %-d %H:%M') END AS clock FROM events")
def event_clock(spark, sf):
    """When every event was, as the status page shows it in its own zone."""
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", T.clock(F.col("ts"), now, "Asia/Kolkata").alias("clock"))


@query("SELECT event_id, left(event_type, 4) AS kind, [left(event_type, 4), left(CAST(user_id AS VARCHAR), 4)] AS tags FROM events")
def attributes_kept(spark, sf):
    """Of every event's attributes the listed ones, cut to four characters, in maps of strings and of lists."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    plain = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("props"), F.col("props"), F.lit("none"), F.lit(None).cast("string"))
    lists = F.create_map(F.lit("tags"), F.array("event_type", F.col("user_id").cast("string")), F.lit("secret"), F.array("props"))
    return e.select("event_id", messages.allowed_attributes(plain, ["kind", "none"], 4)["kind"].alias("kind"), messages.allowed_lists(lists, ["tags"], 4)["tags"].alias("tags"))


@query(f"WITH e AS ({duck(EVAL)}) SELECT id, CASE pred_verdict WHEN 'SCAM' THEN 1.0 WHEN 'SUSPICIOUS' THEN 0.0 WHEN 'SAFE' THEN 0.0 END AS p_scam, CASE pred_verdict WHEN 'SCAM' THEN 0.0 WHEN 'SUSPICIOUS' THEN 0.0 WHEN 'SAFE' THEN 1.0 END AS p_safe FROM e")
def label_only(spark, sf):
    """Probabilities of replies that come without token probabilities."""
    return view(spark, sf, EVAL, "labels").select("id", rules.label_only(F.col("pred_verdict")).alias("p")).select("id", "p.p_scam", "p.p_safe")
