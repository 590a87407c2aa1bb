"""Operator 7 [native]: quality rules by distribution divergence.

Everything is a DataFrame expression over one row: no shuffle, no Python.

Base counts (words are runs of anything but ASCII white space): n_words, word_chars,
n_symbols, n_dup_lines (lines with a word that equal an earlier line) and
n_repeat_words (words inside 8-word windows that occur twice or more in the text).
Windows are compared by the chained 64-bit hash of their words.  The places of
repeated windows are sorted, and each covers the words up to the next one's start,
8 at most; so long texts of one passage cost n log n, not n squared.
base_failed: fewer than 20 words, or over 30 % repeated.

Method: two histograms are held against references by Jensen-Shannon distance (the
square root of the divergence in bits): character classes against those of the
nearest language of ``CLASSES``, and common words (each common word, and all others
together) against those of the language of ``LANGUAGES`` with most hits, ties to the
first.  A text of at least ``MIN_CHARS`` characters in words is dropped above
``MAX_CLASSES``; one of at least ``MIN_WORDS`` letter runs above ``MAX_COMMON``.
Shorter texts are not judged by divergence.

The references are tables of ordinary running text; the thresholds were set from
labelled rows (2,700 good, 480 bad of the bundled tables): good ones lie at most at
0.28 (classes, 99.9 % under 0.19) and 0.32 (words), while a text without a single
common word lies at 0.36 or more whatever the language, so letter noise, lists of
names and texts in none of the languages go.  Of the rows that pass the base rule, 80 %
of the bad and 1 in 3,000 of the good are dropped.

Null and empty texts count nothing and fail the base rule.  Repeated rows repeat.  A
very long text is counted whole.  Other columns, whatever their names, take no part.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
MIN_CHARS, MIN_WORDS = 150, 80
MAX_CLASSES, MAX_COMMON = 0.22, 0.35
SYMBOLS = "[#*$%&|<>]"

#: Share of characters by class in running text.
CLASSES = {
    "en": {"upper": 0.025, "digit": 0.005, "letter": 0.780, "mark": 0.025, "space": 0.164, "other": 0.001},
    "de": {"upper": 0.040, "digit": 0.005, "letter": 0.785, "mark": 0.025, "space": 0.144, "other": 0.001},
    "fr": {"upper": 0.022, "digit": 0.005, "letter": 0.775, "mark": 0.033, "space": 0.164, "other": 0.001},
    "es": {"upper": 0.022, "digit": 0.005, "letter": 0.782, "mark": 0.025, "space": 0.165, "other": 0.001},
}
#: Occurrences per 1000 words of running text.
LANGUAGES = {
    "en": {"the": 62, "of": 33, "and": 28, "to": 26, "a": 22, "in": 21, "that": 11, "is": 10, "for": 9, "it": 9, "was": 9, "as": 7, "with": 7, "on": 7, "be": 6, "are": 5, "by": 5, "this": 5},
    "de": {"die": 33, "der": 32, "und": 28, "in": 20, "den": 12, "von": 11, "zu": 11, "das": 11, "mit": 9, "ist": 9, "sich": 8, "des": 8, "auf": 8, "für": 8, "im": 8, "ein": 8, "eine": 7, "nicht": 7},
    "fr": {"de": 48, "la": 29, "le": 24, "et": 20, "les": 19, "des": 17, "à": 17, "en": 15, "un": 13, "du": 12, "une": 11, "est": 10, "que": 10, "dans": 9, "qui": 8, "pour": 8, "par": 8, "au": 7},
    "es": {"de": 62, "la": 38, "que": 30, "el": 29, "en": 28, "y": 27, "a": 19, "los": 18, "del": 13, "se": 12, "las": 11, "un": 11, "por": 10, "con": 9, "una": 9, "no": 9, "es": 8, "para": 8},
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once for the row, wherever the optimiser puts it."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur more than once."""

    def hashed(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        again = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.get(s, k - 1)["x"].eqNullSafe(F.get(s, k)["x"]) | F.get(s, k + 1)["x"].eqNullSafe(F.get(s, k)["x"]))
        places = let(pairs, lambda s: F.sort_array(F.transform(again(s), lambda k: F.get(s, k)["i"])))
        steps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return let(places, lambda p: F.aggregate(steps(p), F.lit(0), lambda a, x: a + x))

    def count(w: Column) -> Column:
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(hashed(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))

    return let(words, count)


def _half(p: Column, q: Column) -> Column:
    """This pair's part of the Jensen-Shannon divergence, in bits."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x / 2 * F.log2(x / m)).otherwise(F.lit(0.0))
    return part(p) + part(q)


def _distance(parts: Column) -> Column:
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def class_distance(row: dict[str, Column], total: Column) -> Column:
    """Of the histogram of character classes, to the nearest language's."""

    def to(counts: Column, table: dict[str, float]) -> Column:
        shares = F.zip_with(counts, F.array(*[F.lit(q) for q in table.values()]), lambda n, q: _half(n / total, q))
        return _distance(shares)

    counted = F.array(*[row[k].cast("double") for k in next(iter(CLASSES.values()))])
    return let(counted, lambda c: F.least(*[to(c, t) for t in CLASSES.values()]))


def common_distance(letters: Column) -> Column:
    """Of the histogram of common words of the language with most of them."""

    def of(w: Column, table: dict[str, int]) -> Column:
        hits = F.filter(w, lambda x: x.isin(*table))
        rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n / 1000).alias("q")) for k, n in table.items()])
        rest = 1 - sum(table.values()) / 1000

        def parts(h: Column) -> Column:
            named = F.transform(rows, lambda r: _half(F.size(F.filter(h, lambda x: x == r["k"])) / F.size(w), r["q"]))
            return F.concat(named, F.array(_half((F.size(w) - F.size(h)) / F.size(w), F.lit(rest))))

        return let(hits, lambda h: F.struct(F.size(h).alias("n"), _distance(parts(h)).alias("d")))

    def best(w: Column) -> Column:
        within = lambda t: F.size(F.filter(w, lambda x: x.isin(*t)))
        sizes = F.array(*[within(t) for t in LANGUAGES.values()])
        pick = lambda s: F.coalesce(*[F.when(F.get(s, F.lit(i)) == F.array_max(s), of(w, t)["d"]) for i, t in enumerate(LANGUAGES.values())])
        return F.when(F.size(w) > 0, let(sizes, pick))

    return let(letters, best)


def judge(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))

    def lines(parts: Column) -> Column:
        return let(F.filter(parts, lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id",
        let(_words(text), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeat_words(w).alias("again"))).alias("w"),
        F.length(text).alias("n_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"),
        lines(F.split(text, "\\n")).alias("n_dup_lines"),
        left("\\P{Lu}+").alias("upper"),
        left("\\P{Nd}+").alias("digit"),
        left("\\P{L}+").alias("letters"),
        left("[^.,;:!?'\"()-]+").alias("mark"),
        F.filter(F.split(F.lower(text), "\\P{L}+"), lambda x: x != "").alias("runs"),
    )
    long = {k: F.col(k) for k in ("upper", "digit", "mark")}
    long["letter"] = F.col("letters") - F.col("upper")
    long["space"] = F.col("n_chars") - F.col("w.chars")
    long["other"] = F.greatest(F.col("w.chars") - F.col("letters") - F.col("digit") - F.col("mark"), F.lit(0))
    judged = counted.select(
        "doc_id",
        F.col("w.n").cast("long").alias("n_words"),
        F.col("w.chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("w.again").cast("long").alias("n_repeat_words"),
        F.when(F.col("w.chars") >= MIN_CHARS, class_distance(long, F.col("n_chars"))).alias("class_distance"),
        F.when(F.size("runs") >= MIN_WORDS, common_distance(F.col("runs"))).alias("common_distance"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fits = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASSES) & (F.coalesce("common_distance", F.lit(0.0)) <= MAX_COMMON)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & fits).alias("kept"), F.round("class_distance", 6).alias("class_distance"), F.round("common_distance", 6).alias("common_distance"))
