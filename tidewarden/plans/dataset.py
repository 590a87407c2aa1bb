"""Queries of the dataset family: similarity, splits, samples, rates, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import Dictionary
from ..operators import dedupe, messages, phrases, rules, split, variety
from .evaluation import rounded
from .frames import ITEMS, duck, view

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


def _draw(seed: int, purpose: str, key: str) -> str:
    return f"(CAST(('0x' || substr(sha256('{seed}|{purpose}|' || CAST({key} AS VARCHAR)), 1, 12)) AS BIGINT) / 281474976710656.0)"


_GRAMS = "list_distinct(list_transform(range(1, greatest(1, length(text) - 4) + 1), lambda k: substr(lower(text), k, 5)))"


@query(f"SELECT item_id, len({_GRAMS}) AS n FROM benchmark")
def shingle_counts(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.size(dedupe.shingles(F.col("text"))).cast("long").alias("n"))


@query(
    f"WITH g AS (SELECT item_id, {_GRAMS} AS g FROM benchmark), p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.g, b.g)) AS m, len(a.g) + len(b.g) AS t FROM g a JOIN g b ON a.item_id < b.item_id), s AS (SELECT a, b FROM p WHERE 5 * m >= 4 * (t - m) UNION ALL SELECT b, a FROM p WHERE 5 * m >= 4 * (t - m)) SELECT item_id, count(s.b) AS n_similar FROM g LEFT JOIN s ON item_id = s.a GROUP BY item_id"
)
def similar_benchmark(spark, sf):
    ids, pairs = dedupe.similar_sets(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id")
    sizes = ids.groupBy("set_id").agg(F.count("*").alias("n"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes.withColumnRenamed("set_id", "b"), "b").groupBy(F.col("a").alias("set_id")).agg(F.sum("n").alias("m"))
    return ids.join(sizes, "set_id").join(others, "set_id", "left").select(F.col("id").alias("item_id"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_similar"))


def _grams_of(t: str) -> str:
    """All windows of five code points in linear time: the non-overlapping ones from each of five starts."""
    parts = ", ".join(f"regexp_extract_all(substr(lower({t}), {k}), '(?s).{{5}}')" for k in range(1, 6))
    return f"list_sort(list_distinct(list_transform(CASE WHEN length({t}) < 5 THEN [lower({t})] ELSE flatten([{parts}]) END, lambda x: hash(x))))"


#: Pairs of different shingle sets of Jaccard 4/5 or more: of sets of fitting sizes, those that share one of their
#: rarest fifth of shingles (others cannot reach 4/5) are compared whole.
_DOCS = (
    f"d AS MATERIALIZED (SELECT doc_id, {_grams_of('t')} AS g FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)), "
    "s AS MATERIALIZED (SELECT min(doc_id) AS s, g, len(g) AS n FROM d GROUP BY g), u AS (SELECT s, n, unnest(g) AS x FROM s), f AS (SELECT x, count(*) AS c FROM u GROUP BY x), "
    "p AS MATERIALIZED (SELECT s, n, x FROM u JOIN f USING (x) QUALIFY row_number() OVER (PARTITION BY s ORDER BY c, x) <= n - CAST(ceil(n * 0.8) AS BIGINT) + 1), "
    "q AS (SELECT DISTINCT a.s AS a, b.s AS b FROM p a JOIN p b ON a.x = b.x AND a.s < b.s AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4), "
    "e AS MATERIALIZED (SELECT q.a, q.b FROM q JOIN s x ON q.a = x.s JOIN s y ON q.b = y.s WHERE 9 * len(list_intersect(x.g, y.g)) >= 4 * (x.n + y.n))"
)


@query(f"WITH {_DOCS}, k AS (SELECT a AS s FROM e UNION ALL SELECT b FROM e), m AS (SELECT s, count(*) AS n FROM k GROUP BY s) SELECT d.doc_id, s.s AS first_doc, coalesce(m.n, 0) AS n_links FROM d JOIN s ON d.g = s.g LEFT JOIN m ON m.s = s.s")
def similar_documents(spark, sf):
    """Similar documents: every document's class of equal sets and its number of links to others."""
    ids, pairs = dedupe.similar_sets(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").count()
    first = ids.groupBy("set_id").agg(F.min("id").alias("first_doc"))
    return ids.join(first, "set_id").join(degree, "set_id", "left").select(F.col("id").alias("doc_id"), "first_doc", F.coalesce("count", F.lit(0)).alias("n_links"))


@query(f"WITH {_DOCS.split(', s AS')[0]}, b AS (SELECT {_grams_of('text')} AS g FROM benchmark), x AS (SELECT DISTINCT doc_id FROM d JOIN b ON len(d.g) * 5 >= len(b.g) * 4 AND len(b.g) * 5 >= len(d.g) * 4 WHERE 9 * len(list_intersect(d.g, b.g)) >= 4 * (len(d.g) + len(b.g))) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM x)")
def leakage_filter(spark, sf):
    """Documents similar to no benchmark item."""
    return dedupe.without_similar(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"), "doc_id").select("doc_id")


@query(
    f"WITH RECURSIVE {_DOCS}, o AS MATERIALIZED (SELECT d.g, min(CAST(doc_id AS VARCHAR)) AS name FROM d GROUP BY d.g), "
    "c AS MATERIALIZED (SELECT x.name AS a, y.name AS b FROM e JOIN s p ON e.a = p.s JOIN s q ON e.b = q.s JOIN o x ON x.g = p.g JOIN o y ON y.g = q.g), "
    "arc AS MATERIALIZED (SELECT least(a, b) AS first, greatest(a, b) AS later FROM c), n AS MATERIALIZED (SELECT name, row_number() OVER (ORDER BY name) AS k FROM (SELECT DISTINCT later AS name FROM arc)), "
    "walk(k, gone) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT w.k + 1, CASE WHEN EXISTS (SELECT 1 FROM arc WHERE arc.later = n.name AND NOT list_contains(w.gone, arc.first)) THEN list_append(w.gone, n.name) ELSE w.gone END FROM walk w JOIN n ON n.k = w.k + 1), "
    "last AS (SELECT gone FROM walk ORDER BY k DESC LIMIT 1) SELECT CAST(name AS BIGINT) AS doc_id FROM o, last WHERE NOT list_contains(gone, name)"
)
def first_kept(spark, sf):
    """Documents kept by greedy de-duplication in the string order of their ids."""
    return dedupe.first_kept(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").select("doc_id")


#: The greedy rule over arcs (first, later), in the order of names: ``last`` holds the names that go.
_WALK = (
    "n AS MATERIALIZED (SELECT name, row_number() OVER (ORDER BY name) AS k FROM (SELECT DISTINCT later AS name FROM arc)), "
    "walk(k, gone) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT w.k + 1, CASE WHEN EXISTS (SELECT 1 FROM arc WHERE arc.later = n.name AND NOT list_contains(w.gone, arc.first)) THEN list_append(w.gone, n.name) ELSE w.gone END FROM walk w JOIN n ON n.k = w.k + 1), "
    "last AS (SELECT gone FROM walk ORDER BY k DESC LIMIT 1)"
)


_STRATA = (
    "f AS (SELECT seed_group, arg_min(verdict, id) AS v FROM i GROUP BY seed_group), c AS (SELECT seed_group, category, count(*) AS n FROM i GROUP BY ALL), "
    "t AS (SELECT seed_group, category FROM c QUALIFY row_number() OVER (PARTITION BY seed_group ORDER BY n DESC, category) = 1), "
    "st AS (SELECT f.seed_group, CASE WHEN v = 'SUSPICIOUS' THEN 'SUSPICIOUS' ELSE concat(v, '/', t.category) END AS stratum FROM f JOIN t ON f.seed_group = t.seed_group)"
)


@query(f"WITH {_I}, {_STRATA} SELECT * FROM st")
def group_strata(spark, sf):
    return split.strata(_items(spark, sf))


_G = duck(ITEMS).replace("d.source AS seed_group", "concat(d.source, '-', CAST(e.id % 5 AS VARCHAR)) AS seed_group")


@query(
    f"WITH RECURSIVE i AS MATERIALIZED ({_G}), {_STRATA}, o AS (SELECT *, {_draw(7, 'group', 'seed_group')} AS u FROM st), "
    "w AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY u, seed_group) AS k, count(*) OVER (PARTITION BY stratum) AS total FROM o), reach AS MATERIALIZED (SELECT seed_group, stratum, u FROM w WHERE k <= 6 AND k < total), "
    f"z AS MATERIALIZED (SELECT id, CAST(id AS VARCHAR) AS name, seed_group, {_grams_of('t')} AS g FROM (SELECT i.id, i.seed_group, coalesce(i.text, '') AS t FROM i JOIN reach ON i.seed_group = reach.seed_group)), "
    "s AS (SELECT name, seed_group, len(g) AS n, unnest(g) AS x FROM z), fx AS (SELECT x, count(*) AS k FROM s GROUP BY x), p AS MATERIALIZED (SELECT name, seed_group, n, x FROM s JOIN fx USING (x) QUALIFY row_number() OVER (PARTITION BY name ORDER BY k, x) <= n - CAST(ceil(n * 0.8) AS BIGINT) + 1), "
    "q AS (SELECT DISTINCT a.name AS first, b.name AS later FROM p a JOIN p b ON a.x = b.x AND a.seed_group = b.seed_group AND a.name < b.name AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4), "
    "arc AS MATERIALIZED (SELECT q.first, q.later FROM q JOIN z a ON q.first = a.name JOIN z b ON q.later = b.name WHERE 9 * len(list_intersect(a.g, b.g)) >= 4 * (len(a.g) + len(b.g))), "
    f"{_WALK}, y AS MATERIALIZED (SELECT id, seed_group, row_number() OVER (PARTITION BY seed_group ORDER BY {_draw(7, 'item', 'id')}, id) AS r FROM z, last WHERE NOT list_contains(gone, name)), "
    "m AS (SELECT seed_group, least(count(*), 4) AS n FROM y GROUP BY seed_group), v AS (SELECT m.seed_group, coalesce(sum(n) OVER (PARTITION BY stratum ORDER BY u, m.seed_group ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 6 AS dev FROM m JOIN reach ON m.seed_group = reach.seed_group) "
    "SELECT i.id, CASE WHEN NOT coalesce(v.dev, false) THEN 'train' WHEN y.r <= 4 THEN 'dev' ELSE 'dropped' END AS split FROM i LEFT JOIN v ON i.seed_group = v.seed_group LEFT JOIN y ON i.id = y.id"
)
def group_split(spark, sf):
    rows = _items(spark, sf).withColumn("seed_group", F.concat_ws("-", "seed_group", (F.col("id") % 5).cast("string")))
    return split.split_groups(rows, 6, 4).select("id", "split")


@query(f"WITH {_I}, o AS (SELECT id, row_number() OVER (ORDER BY {_draw(3, 'shuffle', 'id')}, id) - 1 AS place FROM i) SELECT id, place, CAST(floor(place / 32) AS BIGINT) AS batch FROM o")
def shuffled_batches(spark, sf):
    return split.shuffled(_items(spark, sf), "id", 3, batch=32).select("id", "place", "batch")


@query(f"WITH {_I} SELECT id FROM i ORDER BY {_draw(7, 'review', 'id')}, id LIMIT (SELECT greatest(1, CAST(round_even(count(*) * 0.10, 0) AS BIGINT)) FROM i)")
def review_sample(spark, sf):
    return split.review_sample(_items(spark, sf), "id").select("id")


#: Items whose texts go on with what the rules on ids, links, emoji and placeholders look for.
_ENDS = ("' Ref No: 12345'", "' संदर्भ संख्या: 99'", "' Order ID 5512'", "' see www.shop.example/x'", "' A/c XX12 😊'", "' [bank name]'", "' <Your Name>'", "' 🎉 consumer no 7'", "' txn ids'", "' [OTP 4]'")
_MORE = "CASE id % 13 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(_ENDS)) + " ELSE '' END"
TOLD = f"SELECT id, verdict, category, language, obfuscated, hard_negative, source, seed_group, channel, sender, concat(text, {_MORE}) AS text FROM ({ITEMS}) m"
_T = f"i AS ({duck(TOLD)})"
_EDGE = r"[^\p{L}\p{N}_]"
_DOUBTED = Dictionary(sites=("bank.test",), phrases={"urgency": ("the", "und"), "payment": ("for", "für")})


def _told(spark, sf):
    return view(spark, sf, TOLD, "labels", "documents")


def _says(words: str, whole: bool = True) -> str:
    return f"regexp_matches(text, '(?i)(^|{_EDGE})({words})" + (f"($|{_EDGE})')" if whole else "')")


_BRACKETS = r"(regexp_matches(regexp_replace(text, '\[OTP [^\[\]]*\]', '', 'g'), '\[[^\[\]]{0,40}\]') OR regexp_matches(regexp_replace(text, '<(OTP|ACCT|PHONE)>', '', 'g'), '<[A-Za-z ]{2,30}>'))"
_DEVANAGARI = r"regexp_matches(text, '[\x{0900}-\x{097F}]')"
_DOUBTS = {
    "safe_urgency_payment": f"verdict = 'SAFE' AND {_says('the|und')} AND {_says('for|für')}", "safe_nonofficial_link": "verdict = 'SAFE' AND contains(text, 'www.shop.example')", "placeholder": _BRACKETS,
    "lang_hi_without_devanagari": f"language = 'hi' AND NOT {_DEVANAGARI}", "lang_en_with_devanagari": f"language = 'en' AND {_DEVANAGARI}",
}


@query(
    f"WITH {_T}, s AS (SELECT * FROM i ORDER BY {_draw(7, 'review', 'id')}, id LIMIT (SELECT greatest(1, CAST(round_even(count(*) * 0.10, 0) AS BIGINT)) FROM i)), r AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS reason, id FROM s WHERE {c}" for k, c in _DOUBTS.items())
    + "), g AS (SELECT reason, count(*) AS count FROM r GROUP BY reason UNION ALL SELECT NULL, count(DISTINCT id) FROM r) SELECT reason, count, round(count / (SELECT count(*) FROM s), 6) AS share FROM g"
)
def suspect_reasons(spark, sf):
    """The six reasons for doubt over the review sample; none asks for a code with this dictionary."""
    sample = split.review_sample(_told(spark, sf), "id").withColumn("m", T.normalize_message(F.col("text"), F.col("sender")))
    return rounded(split.suspects(sample, messages.doubts(sample, rules.Rules(_DOUBTED), F.col("m"))), "share")


@query(f"WITH {_I} SELECT id, NOT (id % 2 = 0 AND {_draw(7, 'dropout', 'id')} < 0.2) AS has_signals FROM i")
def signal_dropout(spark, sf):
    where = F.when(F.col("id") % 2 == 0, "train").otherwise("dev")
    return _items(spark, sf).select("id", (F.size(split.drop_signals(where, F.array(F.lit("apk_link")), F.col("id"))) > 0).alias("has_signals"))


_FAMILIES = {
    "id_ref": _says("ref|reference"), "id_order": _says("order id|awb|tracking id"), "id_case": _says("consumer no|ack no|case id"), "id_payment": _says("txn id|upi ref", False),
    "id_account": "regexp_matches(lower(text), 'a/c xx[0-9]')", "id_hindi": "contains(text, 'संदर्भ संख्या')",
    "id_any": f"({_says('ref|reference')} OR {_says('order id|awb|tracking id|consumer no|ack no|case id|txn id|upi ref', False)} OR regexp_matches(lower(text), 'a/c xx[0-9]') OR contains(text, 'संदर्भ'))",
}
_ANY_ID = _FAMILIES["id_any"]
_RATES = (
    f"s AS (SELECT verdict, count(*) AS n, count(*) FILTER ({_ANY_ID}) AS nat, count(*) FILTER (NOT {_ANY_ID} AND category NOT IN ('personal', 'legit_promo')) AS elig, "
    f"count(*) FILTER ({_ANY_ID} AND contains(text, 'संदर्भ संख्या')) AS lab, count(*) FILTER (NOT {_ANY_ID} AND category NOT IN ('personal', 'legit_promo') AND language = 'hi') AS hi FROM i GROUP BY verdict), "
    "r AS (SELECT *, least(1, greatest(0, coalesce((0.4 * n - nat) / nullif(elig, 0), 0))) AS rate, (SELECT max(lab / n) FROM s) AS most FROM s)"
)


@query(f"WITH {_T}, {_RATES} SELECT verdict, round(nat / n, 6) AS native, round(elig / n, 6) AS eligible, round(rate, 6) AS rate, round(least(1, greatest(0, coalesce((most * n - lab) / nullif(rate * hi, 0), 0))), 6) AS hindi_rate FROM r")
def reference_rates(spark, sf):
    return rounded(variety.reference_rates(_told(spark, sf)), "native", "eligible", "rate", "hindi_rate")


_SIGNS = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B06}\x{2B50}\x{FE0F}]"
_STATUS = "CASE WHEN sender IS NULL THEN 'unknown' WHEN regexp_matches(sender, '^[A-Z]{2}-[A-Z0-9]{3,9}$') THEN 'registered' WHEN regexp_matches(sender, '^\\+?[0-9 ]+$') THEN 'unregistered' ELSE 'unknown' END"
_SHARES = (
    {f"channel_{c}": f"channel = '{c}'" for c in ("sms", "whatsapp", "call_description", "screenshot")} | {f"sender_{k}": f"({_STATUS}) = '{k}'" for k in ("registered", "unregistered", "unknown")}
    | {"digit_run": r"regexp_matches(text, '\d{4}')", "has_url": "contains(text, 'www.shop.example')", "has_emoji": f"regexp_matches(text, '{_SIGNS}')", "leading_emoji": f"regexp_matches(text, '^{_SIGNS}')"} | _FAMILIES
)


@query(f"WITH {_T} SELECT verdict, count(*) AS n, " + ", ".join(f"round(avg(CAST({c} AS INT)), 2) AS {k}" for k, c in _SHARES.items()) + " FROM i GROUP BY verdict")
def shortcut_report(spark, sf):
    return variety.shortcut_report(_told(spark, sf))


@query(f"WITH {_I} SELECT coalesce(bool_and(source = 'synthetic'), false) AND count(*) > 0 AS provisional FROM i")
def provisional_marker(spark, sf):
    return split.is_provisional(_items(spark, sf))


_JOBS = "j AS (SELECT item_id, s.s AS scenario, v.v AS variant, concat(CAST(item_id AS VARCHAR), '/', CAST(s.s AS VARCHAR), '/', CAST(v.v AS VARCHAR)) AS key FROM benchmark, range(0, 5) s(s), range(0, 3) v(v))"


@query(f"WITH {_JOBS} SELECT key, scenario, variant FROM j WHERE NOT (item_id % 2 = 0 AND variant = 0)")
def open_jobs(spark, sf):
    jobs = split.planned_jobs(spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("seed_id")), 5, 3)
    return split.open_jobs(jobs, jobs.filter("seed_id % 2 = 0 AND variant = 0").select("key")).select("key", "scenario", "variant")


_FIRST = "ORDER BY plain DESC, u, id LIMIT 1"


@query(
    f"WITH {_I}, k AS (SELECT id, verdict, category, language, hard_negative AS hard, NOT obfuscated AND length(text) <= 400 AS plain, {_draw(7, 'fewshot', 'id')} AS u FROM i), "
    f"s1 AS (SELECT * FROM k WHERE verdict = 'SCAM' {_FIRST}), sa AS (SELECT k.* FROM k, s1 WHERE k.verdict = 'SCAM' AND k.category <> s1.category AND k.language <> s1.language ORDER BY k.plain DESC, k.u, k.id LIMIT 1), "
    f"sb AS (SELECT k.* FROM k, s1 WHERE k.verdict = 'SCAM' AND k.category <> s1.category ORDER BY k.plain DESC, k.u, k.id LIMIT 1), s2 AS (SELECT * FROM sa UNION ALL SELECT * FROM sb WHERE NOT EXISTS (SELECT 1 FROM sa)), "
    f"h1 AS (SELECT * FROM k WHERE verdict = 'SAFE' AND hard AND category = 'genuine_otp' {_FIRST}), h2 AS (SELECT * FROM k WHERE verdict = 'SAFE' AND hard AND category = 'transaction_alert' {_FIRST}), "
    f"su AS (SELECT * FROM k WHERE verdict = 'SUSPICIOUS' {_FIRST}), pe AS (SELECT * FROM k WHERE verdict = 'SAFE' AND category = 'personal' {_FIRST}) "
    "SELECT id, 'scam' AS kind, 1 AS position FROM s1 UNION ALL SELECT id, 'hard_negative', 2 FROM h1 UNION ALL SELECT id, 'suspicious', 3 FROM su UNION ALL SELECT id, 'scam', 4 FROM s2 UNION ALL SELECT id, 'safe_personal', 5 FROM pe UNION ALL SELECT id, 'hard_negative', 6 FROM h2"
)
def fewshot_rows(spark, sf):
    """The six few-shot rows, in the prompt's order."""
    return variety.fewshot(_items(spark, sf)).select("id", "kind", "position")


@query(f"WITH {_I} SELECT DISTINCT id FROM i WHERE id % 50 = 0 OR seed_group = 'src3'")
def fewshot_leaks(spark, sf):
    items = _items(spark, sf)
    return split.leaks(items.select("id", "seed_group"), items.filter("id % 50 = 0").select("id", F.lit("src3").alias("seed_group"))).select("id").distinct()


def _u(purpose: str) -> str:
    return _draw(7, purpose, "id")


def _digits(purpose: str, n) -> str:
    return f"right(lpad(CAST(CAST(floor({_u(purpose)} * 1000000000000) AS BIGINT) AS VARCHAR), 12, '0'), {n})"


def _place(purpose: str, n: int) -> str:
    return f"CAST(floor({_u(purpose)} * {n}) AS INT)"


def _ending(ending, purpose: str) -> str:
    label, least, most = ending
    return f"concat('{label}', {_digits(purpose + '-digits', _place(purpose + '-size', most - least + 1) + f' + {least}')})"


def _number(p: str) -> str:
    return f"concat('+91 ', substr('6789', {_place(p + '-first', 4)} + 1, 1), {_digits(p + '-four', 4)}, ' ', {_digits(p + '-five', 5)})"


def _header(p: str) -> str:
    letters = lambda part, own, n: ", ".join(f"substr('{own}', {_place(f'{p}-{part}{i}', len(own))} + 1, 1)" for i in range(n))
    return f"concat({letters('head', variety.HEAD_LETTERS, 2)}, '-', {letters('tail', variety.TAIL_LETTERS, 6)})"


_WITH_ID = f"{_u('id')} < CASE verdict WHEN 'SCAM' THEN 0.4 WHEN 'SAFE' THEN 0.3 ELSE 0.6 END AND category NOT IN ('personal', 'legit_promo') AND NOT {_ANY_ID}"
_ENDING = f"CASE WHEN language = 'hi' AND {_u('hindi')} < CASE verdict WHEN 'SCAM' THEN 0.9 ELSE 0.5 END THEN {_ending(variety.HINDI_ENDING, 'hindi')} ELSE [{', '.join(_ending(e, 'id') for e in variety.ENDINGS)}][{_place('id-kind', len(variety.ENDINGS))} + 1] END"
_GAP = f"CASE WHEN channel = 'whatsapp' AND {_u('gap')} < 0.3 THEN chr(10) ELSE ' ' END"
_CHEER = "CASE category " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(e) for e in own)}][{_place('emoji-kind', len(own))} + 1]" for k, own in variety.EMOJI.items()) + " END"


@query(
    f"WITH {_T}, a AS (SELECT id, verdict, category, concat(text, CASE WHEN {_WITH_ID} THEN concat({_GAP}, {_ENDING}) ELSE '' END, CASE WHEN verdict = 'SAFE' AND {_u('emoji')} < 0.15 AND {_CHEER} IS NOT NULL THEN concat(' ', {_CHEER}) ELSE '' END) AS text, "
    f"CASE WHEN channel IN ('sms', 'whatsapp') AND {_u('screenshot')} < 0.15 THEN 'screenshot' ELSE channel END AS channel, CASE WHEN channel = 'call_description' THEN sender "
    f"WHEN verdict = 'SAFE' AND category = 'personal' THEN CASE WHEN {_u('contact')} < 0.45 THEN {_number('number')} WHEN {_u('contact')} < 0.6 THEN NULL ELSE sender END WHEN verdict = 'SAFE' AND category = 'delivery_update' AND {_u('contact')} < 0.15 THEN {_number('number')} "
    f"WHEN verdict <> 'SAFE' AND ({_STATUS}) <> 'registered' AND {_u('spoof')} < 0.2 THEN {_header('spoof')} ELSE sender END AS sender FROM i) "
    f"SELECT id, md5(text) AS digest, channel, CASE WHEN {_u('no_sender')} < 0.5 THEN NULL WHEN ({_STATUS}) = 'unknown' AND category <> 'personal' THEN CASE WHEN {_u('known')} < 0.7 THEN {_number('known')} ELSE {_header('known')} END ELSE sender END AS sender FROM a"
)
def diversified(spark, sf):
    rows = variety.diversify(_told(spark, sf).withColumn("red_flags", F.array(F.struct(F.left("text", F.lit(3)).alias("quote"), F.lit("secrecy_request").alias("reason")))), {"SCAM": 0.4, "SAFE": 0.3, "SUSPICIOUS": 0.6}, {"SCAM": 0.9})
    return rows.select("id", F.md5("text").alias("digest"), "channel", "sender")


@query(f"WITH {_T} SELECT id, contains(text, 'www.shop.example/x') AND id % 4 <> 0 AS accepted FROM i")
def link_acceptance(spark, sf):
    """Messages that must hold the link asked for, on hosts of the list, without a signal that speaks against it."""
    soft = F.when(F.col("id") % 4 == 0, F.array(F.lit("shortener_link"))).otherwise(F.array(F.lit("threat_lexicon")))
    good = messages.acceptable_link(F.col("text"), T.urls(F.col("text")), F.lit("www.shop.example/x"), ["www.shop.example"], soft)
    return _told(spark, sf).select("id", F.coalesce(good, F.lit(False)).alias("accepted"))


@query(f"WITH {_T} SELECT id, verdict = 'SAFE' AND (category IN ('genuine_otp', 'transaction_alert') OR " + " OR ".join(f"contains(lower(text), '{w.replace(chr(39), chr(39) * 2)}')" for w in messages.ALARMS) + ") AS hard FROM i")
def hard_negatives(spark, sf):
    return _told(spark, sf).select("id", messages.hard_negative_wide(F.col("verdict"), F.col("category"), F.col("text")).alias("hard"))


@query(f"WITH {_JOBS} SELECT key, item_id % 3 <> 0 AS found FROM j WHERE variant > 0")
def scenario_lookup(spark, sf):
    """Variants with the text of their scenario; those of a scenario that is not there are found out, not run."""
    given = spark.read.parquet(f"{sf}/benchmark.parquet")
    jobs = split.planned_jobs(given.select(F.col("item_id").alias("seed_id"), "text"), 5, 3)
    return split.with_scenario(jobs.filter("variant > 0").drop("text"), jobs.filter("variant = 0 AND seed_id % 3 <> 0")).select("key", F.col("scenario_text").isNotNull().alias("found"))


_PAIRS = r"SELECT DISTINCT lower(regexp_extract(text, '^[\p{L}]+ [\p{L}]+')) AS phrase FROM benchmark"


@query(
    f"WITH p AS ({_PAIRS}), d AS (SELECT doc_id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t FROM documents) SELECT doc_id, phrase FROM d, p WHERE phrase <> '' AND contains(t, phrase) "
    f"AND regexp_matches(t, concat('(^|{_EDGE})', phrase, '($|{_EDGE})'))"
)
def phrase_matches(spark, sf):
    """Which documents hold which of the benchmark's first word pairs, as whole words."""
    given = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.lower(F.regexp_extract("text", r"^[\p{L}]+ [\p{L}]+", 0)).alias("phrase"))
    return phrases.phrase_places(spark.read.parquet(f"{sf}/documents.parquet"), given, "doc_id").select("doc_id", "phrase").distinct()
