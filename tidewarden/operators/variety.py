"""Variation of generated messages, and the rates and reports that keep it from giving the label away.

Rates are measured first (``reference_rates``), then every message is varied by draws
that are hashes of its id (``diversify``), and ``shortcut_report`` shows per verdict what
a model could take for the label.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .split import draw, fill_placeholders

# What shows that a text carries an id, by family; endings an id is given in, with least and most digits.
REFERENCE_WORDS = ("ref", "reference")
ORDER_WORDS = ("order id", "awb", "tracking id")
CASE_WORDS = ("consumer no", "ack no", "case id")
PAYMENT_WORDS = ("txn id", "upi ref")
ACCOUNT_MARK = "a/c xx"
HINDI_LABEL, HINDI_WORD = "संदर्भ संख्या", "संदर्भ"
ENDINGS = (
    ("Ref No: ", 8, 12), ("Ref ", 6, 9), ("UPI Ref No: ", 8, 12), ("Txn ID ", 10, 12), ("A/c XX", 4, 4), ("Order ID ", 8, 12),
    ("AWB ", 10, 12), ("Tracking ID ", 10, 12), ("Consumer No. ", 10, 12), ("Ack No ", 8, 12), ("Case ID ", 6, 9),
)
HINDI_ENDING = (f"{HINDI_LABEL}: ", 8, 12)
#: Categories whose texts get no id.
WITHOUT_ID = ("personal", "legit_promo")
EMOJI = {"personal": ("🙏", "😊", "👍", "❤️", "🙂"), "legit_promo": ("🎉", "🔥", "🛍️", "✨"), "delivery_update": ("📦", "🚚", "✅")}
EMOJI_SIGNS = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B06}\\x{2B50}\\x{FE0F}]"
HEAD_LETTERS, TAIL_LETTERS = "ABCDEFGHIJKLMNOPRSTUVW", "ABCDEFGHIKLMNOPRSTUVY"
TARGET, HINDI_SHARE, NEW_LINE, EMOJI_RATE, SPOOFED, SCREENSHOT, NO_SENDER, TO_NUMBER = 0.40, 0.5, 0.3, 0.15, 0.20, 0.15, 0.5, 0.7
CONTACT_TO_NUMBER, CONTACT_TO_NONE, AGENT_NUMBER = 0.45, 0.60, 0.15

_EDGE = r"[^\p{L}\p{N}_]"


def _says(text: Column, words, whole: bool = True) -> Column:
    """One of the words begins (and, if ``whole``, ends) like a word."""
    return text.rlike(f"(?iu)(?:^|{_EDGE})(?:{'|'.join(words)})" + (f"(?:$|{_EDGE})" if whole else ""))


def id_families(text: Column) -> dict[str, Column]:
    """Which families of ids a text shows; ``any`` is wider than their union: an id word may go on, the Hindi word may stand alone."""
    account = F.lower(text).rlike(rf"\Q{ACCOUNT_MARK}\E[0-9]")
    return {
        "ref": _says(text, REFERENCE_WORDS), "order": _says(text, ORDER_WORDS), "case": _says(text, CASE_WORDS), "payment": _says(text, PAYMENT_WORDS, False), "account": account, "hindi": F.contains(text, F.lit(HINDI_LABEL)),
        "any": _says(text, REFERENCE_WORDS) | _says(text, (*ORDER_WORDS, *CASE_WORDS, *PAYMENT_WORDS), False) | account | F.contains(text, F.lit(HINDI_WORD)),
    }


def reference_rates(items: DataFrame, target: float = TARGET) -> DataFrame:
    """Per verdict: share of texts with an id, share that may get one, the rate at which they do so that ``target`` is
    reached, and the share of the Hindi ones' ids that get the Hindi label so that it is as frequent for every verdict."""
    has = F.coalesce(id_families(F.col("text"))["any"], F.lit(False))
    may = ~has & ~F.coalesce(F.col("category").isin(*WITHOUT_ID), F.lit(False))
    counts = items.groupBy("verdict").agg(
        F.count("*").alias("n"), F.count_if(has).alias("native"), F.count_if(may).alias("eligible"),
        F.count_if(has & F.contains("text", F.lit(HINDI_LABEL))).alias("labelled"), F.count_if(may & (F.col("language") == "hi")).alias("hindi"),
    )
    clamped = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))
    most = F.max(F.col("labelled") / F.col("n")).over(Window.partitionBy())  # a row a verdict
    rated = counts.withColumns({"rate": clamped(F.try_divide(target * F.col("n") - F.col("native"), "eligible")), "most": most})
    hindi = clamped(F.try_divide(F.col("most") * F.col("n") - F.col("labelled"), F.col("rate") * F.col("hindi")))
    return rated.select("verdict", (F.col("native") / F.col("n")).alias("native"), (F.col("eligible") / F.col("n")).alias("eligible"), "rate", hindi.alias("hindi_rate"))


def shortcut_report(items: DataFrame, suffixes=None) -> DataFrame:
    """Per verdict the share of surface features that a model could take for the label, to two places."""
    share = lambda c, n: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 2).alias(n)
    text, status = F.col("text"), T.sender_status(F.col("sender"))
    return items.groupBy("verdict").agg(
        F.count("*").alias("n"), *[share(F.col("channel") == c, f"channel_{c}") for c in ("sms", "whatsapp", "call_description", "screenshot")], *[share(status == s, f"sender_{s}") for s in ("registered", "unregistered", "unknown")],
        share(text.rlike(r"(?U)\d{4}"), "digit_run"), share(F.size(T.urls(text, suffixes)) > 0, "has_url"), share(text.rlike(EMOJI_SIGNS), "has_emoji"), share(text.rlike("^" + EMOJI_SIGNS), "leading_emoji"),
        *[share(c, f"id_{k}") for k, c in id_families(text).items()],
    )


class _Draws:
    """Numbers, choices and digits of one item, each a hash of (seed, purpose, id)."""

    def __init__(self, seed: int, key: Column):
        self.seed, self.key = seed, key

    def __call__(self, purpose: str) -> Column:
        return draw(self.seed, purpose, self.key)

    def place(self, purpose: str, n) -> Column:
        return F.floor(self(purpose) * n).cast("int")

    def one_of(self, purpose: str, values) -> Column:
        return F.get(F.array(*map(F.lit, values)), self.place(purpose, len(values)))

    def digits(self, purpose: str, n: Column | int) -> Column:
        return F.right(F.lpad(F.floor(self(purpose) * 10**12).cast("string"), 12, "0"), F.lit(n) if isinstance(n, int) else n)

    def letters(self, purpose: str, letters: str, n: int) -> Column:
        return F.concat(*[F.substr(F.lit(letters), self.place(f"{purpose}{i}", len(letters)) + 1, F.lit(1)) for i in range(n)])

    def number(self, purpose: str) -> Column:
        return F.concat(F.lit("+91 "), self.one_of(f"{purpose}-first", "6789"), self.digits(f"{purpose}-four", 4), F.lit(" "), self.digits(f"{purpose}-five", 5))

    def header(self, purpose: str) -> Column:
        return F.concat(self.letters(f"{purpose}-head", HEAD_LETTERS, 2), F.lit("-"), self.letters(f"{purpose}-tail", TAIL_LETTERS, 6))

    def ending(self, ending: tuple[str, int, int], purpose: str) -> Column:
        label, least, most = ending
        return F.concat(F.lit(label), self.digits(f"{purpose}-digits", self.place(f"{purpose}-size", most - least + 1) + least))


def _by_verdict(rates: dict[str, float], otherwise: float) -> Column:
    return F.coalesce(*[F.when(F.col("verdict") == v, F.lit(float(r))) for v, r in sorted(rates.items())], F.lit(otherwise))


def diversify(items: DataFrame, id_rates: dict[str, float] | None = None, hindi_rates: dict[str, float] | None = None, seed: int = 7) -> DataFrame:
    """Messages varied one by one: placeholders filled; ids of eleven kinds at the verdict's rate; emoji on three kinds of
    genuine messages; numbers, no sender or contact names for genuine ones, spoofed headers for others; screenshots of
    sms and whatsapp; half of all senders dropped, and of those kept none unknown but personal contacts.

    Needs id, text, red_flags, verdict, category, language, channel and sender.  Rows whose flags a placeholder takes go.
    """
    d = _Draws(seed, F.col("id"))
    rows = fill_placeholders(items, seed)
    safe, category = F.col("verdict") == "SAFE", F.coalesce("category", F.lit(""))

    ending = F.get(F.array(*[d.ending(e, "id") for e in ENDINGS]), d.place("id-kind", len(ENDINGS)))
    ending = F.when((F.col("language") == "hi") & (d("hindi") < _by_verdict(hindi_rates or {}, HINDI_SHARE)), d.ending(HINDI_ENDING, "hindi")).otherwise(ending)
    gap = F.when((F.col("channel") == "whatsapp") & (d("gap") < NEW_LINE), "\n").otherwise(" ")
    with_id = (d("id") < _by_verdict(id_rates or {}, TARGET)) & ~category.isin(*WITHOUT_ID) & ~id_families(F.col("text"))["any"]
    emoji = F.coalesce(*[F.when(category == k, d.one_of("emoji-kind", own)) for k, own in EMOJI.items()])
    text = F.concat("text", F.when(with_id, F.concat(gap, ending)).otherwise(""), F.coalesce(F.when(safe & (d("emoji") < EMOJI_RATE), F.concat(F.lit(" "), emoji)), F.lit("")))

    called = F.coalesce(F.col("channel") == "call_description", F.lit(False))
    number, r = d.number("number"), d("contact")
    contact = F.when(r < CONTACT_TO_NUMBER, number).when(r < CONTACT_TO_NONE, F.lit(None)).otherwise(F.col("sender"))
    sender = (
        F.when(safe & ~called & (category == "personal"), contact).when(safe & ~called & (category == "delivery_update") & (r < AGENT_NUMBER), number)
        .when(~safe & ~called & (T.sender_status(F.col("sender")) != "registered") & (d("spoof") < SPOOFED), d.header("spoof")).otherwise(F.col("sender"))
    )
    channel = F.when(F.col("channel").isin("sms", "whatsapp") & (d("screenshot") < SCREENSHOT), "screenshot").otherwise(F.col("channel"))
    rows = rows.withColumns({"text": text, "sender": sender, "channel": channel})
    replaced = F.when(d("known") < TO_NUMBER, d.number("known")).otherwise(d.header("known"))
    unknown = (T.sender_status(F.col("sender")) == "unknown") & (category != "personal")
    return rows.withColumn("sender", F.when(d("no_sender") < NO_SENDER, F.lit(None)).when(unknown, replaced).otherwise(F.col("sender")))


# -- few-shot rows -------------------------------------------------------------------
#: The prompt's order.
FEWSHOT_ORDER = ("scam", "hard_negative", "suspicious", "scam", "safe_personal", "hard_negative")
FEWSHOT_CHARS = 400
#: Rows kept of each kind, category and language, plain and not: five may be taken before one is looked for.
_NEAREST = 6


def fewshot(items: DataFrame, seed: int = 7) -> DataFrame:
    """The six rows of the prompt with kind and position (from 1), or an error that names the kinds that are missing.

    Plain rows (not obfuscated, 400 characters at most) are drawn from where there are any.  The second SCAM is of
    another category, and of another language if one such exists; the hard negatives are one of each of their two
    categories if they exist, else any.  No row is taken twice.  The draw is a hash of the id.
    """
    safe, scam = F.col("verdict") == "SAFE", F.col("verdict") == "SCAM"
    hard, personal = safe & F.coalesce("hard_negative", F.lit(False)), safe & F.coalesce(F.col("category") == "personal", F.lit(False))
    plain = ~F.coalesce("obfuscated", F.lit(False)) & (F.length("text") <= FEWSHOT_CHARS)
    traits = [scam.alias("scam"), hard.alias("hard"), (F.col("verdict") == "SUSPICIOUS").alias("suspicious"), personal.alias("personal"), plain.alias("plain")]
    near = items.select("id", "category", "language", *traits, draw(seed, "fewshot", F.col("id")).alias("u")).filter(reduce(or_, [F.col(k) for k in ("scam", "hard", "suspicious", "personal")]))
    kind = ["scam", "hard", "suspicious", "personal", "category", "language", "plain"]
    rows = near.withColumn("n", F.row_number().over(Window.partitionBy(*kind).orderBy("u", "id"))).filter(F.col("n") <= _NEAREST)
    short = sorted(rows.collect(), key=lambda r: (r.u, str(r.id)))  # _NEAREST rows a combination of closed vocabularies
    taken: set = set()

    def pick(fits):
        pool = [r for r in short if fits(r)]
        free = [r for r in [r for r in pool if r.plain] or pool if r.id not in taken]
        if not free:
            return None
        taken.add(free[0].id)
        return free[0]

    first = pick(lambda r: r.scam)
    second = first and (pick(lambda r: r.scam and r.category != first.category and r.language != first.language) or pick(lambda r: r.scam and r.category != first.category))
    each = [pick(lambda r, k=k: r.hard and r.category == k) for k in ("genuine_otp", "transaction_alert")]
    hards = [r for r in each if r]
    while len(hards) < 2 and (more := pick(lambda r: r.hard)):
        hards.append(more)
    found = {"scam": [r for r in (first, second) if r], "hard_negative": hards}
    found["suspicious"] = [r for r in [pick(lambda r: r.suspicious)] if r]
    found["safe_personal"] = [r for r in [pick(lambda r: r.personal)] if r]
    missing = {k: FEWSHOT_ORDER.count(k) - len(own) for k, own in found.items() if len(own) < FEWSHOT_ORDER.count(k)}
    if missing:
        raise ValueError(f"too few rows for the few-shot kinds {missing}")
    places = [(found[k][FEWSHOT_ORDER[:i].count(k)].id, k, i + 1) for i, k in enumerate(FEWSHOT_ORDER)]
    chosen = items.sparkSession.createDataFrame(places, f"id {items.schema['id'].dataType.simpleString()}, kind string, position int")
    return items.join(F.broadcast(chosen), "id")  # six rows
