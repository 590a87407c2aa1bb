"""The pool of items a dataset is built from: allow-lists, joins of labels and messages, unions, items without a sender."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import BUILT_IN, Dictionary
from . import messages, rules

# Sources of messages that people received themselves.
REAL_SOURCES = ("family_real", "own_inbox")
LABEL_FIELDS = ("verdict", "category", "red_flags", "language", "source_phone", "obfuscated", "seed_group")


def labelled(items: DataFrame, labels: DataFrame, sources=REAL_SOURCES) -> DataFrame:
    """Items with their label, both of an allowed source; items labelled as test, and labels without an item, are left out.

    A label without seed_group is a group of its own.
    """
    own = labels.filter(F.col("source").isin(*sources) & ~F.coalesce("is_test", F.lit(False)))
    return _joined(items.filter(F.col("source").isin(*sources)), own)


def frozen_items(items: DataFrame, labels: DataFrame, sources=REAL_SOURCES) -> tuple[DataFrame, DataFrame]:
    """(test items, problems): every label marked as test with its item; problems are labels without an item, of another source, or with a quote that no longer stands in the text."""
    marked = labels.filter("is_test")
    both = marked.select("id", F.col("source").alias("_ls"), "red_flags").join(items.select("id", F.col("source").alias("_is"), T.normal_text(F.col("text")).alias("_t")), "id", "left")
    allowed = F.coalesce(F.col("_ls").isin(*sources) & F.col("_is").isin(*sources), F.lit(False))
    loose = F.exists("red_flags", lambda f: ~F.contains(F.col("_t"), T.tidy(f["quote"])))
    reason = F.when(F.col("_t").isNull(), "no_item").when(~allowed, "not_real").when(F.coalesce(loose, F.lit(False)), "loose_quote")
    return _joined(items, marked), both.select("id", reason.alias("problem")).filter("problem is not null")


def _joined(items: DataFrame, labels: DataFrame) -> DataFrame:
    fields = [c for c in LABEL_FIELDS if c in labels.columns]
    joined = items.drop(*fields).join(labels.select("id", *fields), "id")
    return joined.withColumn("seed_group", F.coalesce(*(["seed_group"] if "seed_group" in fields else []), F.col("id").cast("string")))


def pool(*parts: DataFrame) -> DataFrame:
    """All rows of the parts, repeated ones too; ``part`` numbers them in the order given, columns that a part lacks are null."""
    out = parts[0].withColumn("part", F.lit(0))
    for n, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("part", F.lit(n)), allowMissingColumns=True)
    return out


def without_sender(items: DataFrame, data: Dictionary = BUILT_IN) -> DataFrame:
    """Items as if shared without a sender: sender null, signals found anew, the prompt rendered anew."""
    none = F.lit(None).cast("string")
    found = items.withColumn("_s", rules.Rules(data).evaluate(T.normalize_message(F.col("text"), none)))
    signals = F.concat("_s.hard", "_s.soft")
    return found.withColumns({"sender": none, "signals": signals, "user_message": messages.user_message(F.col("channel"), none, F.lit("unknown"), signals, F.col("text"))}).drop("_s")


def checked_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """The frame itself; raises on no rows, a null id or an id that stands twice."""
    n, named, distinct = df.agg(F.count("*"), F.count(key), F.count_distinct(key)).first()
    if not n or named < n or distinct < n:
        raise ValueError("no rows" if not n else "an id is null" if named < n else "an id stands twice")
    return df


def html_escaped(text: Column) -> Column:
    """Safe inside HTML text and attributes; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def load_thresholds(spark: SparkSession, path: str | None = None, high: float | None = None, low: float | None = None) -> tuple[float, float, bool]:
    """(T_HIGH, T_LOW, both given): from a JSON file, else the settings handed in, else the defaults."""
    given = (None, None)
    if path is not None:
        try:
            row = spark.read.text(path, wholetext=True).select(F.from_json("value", "T_HIGH double, T_LOW double").alias("t")).select("t.*").first()
            given = tuple(row) if row else given
        except Exception as error:  # noqa: BLE001  a file that is not there is no error
            if "PATH_NOT_FOUND" not in str(error):
                raise
    both = [a if a is not None else b for a, b in zip(given, (high, low))]
    return (*[v if v is not None else d for v, d in zip(both, rules.DEFAULT_THRESHOLDS)], all(v is not None for v in both))
