"""Bounded samples of labelled rows for the classifiers.

The rule is one for all sizes: rows outside the held-out fold (``FOLD``: crc32(doc_id
as text) mod 5 is 0, unless the operator has a fold of its own) may be learned from; of each class, the ``per_class`` ids least by a hash of doc_id are
taken (ties by doc_id), so every class is learned however many there are.  The bound
is ``per_class`` rows times the number of classes: it grows with the label values, not
with the rows.  Ids are ranked in ``SALTS`` parts of each class first, and what the parts
keep by class then, so a class of a third of all rows is dealt over many tasks and brings
``SALTS`` times ``per_class`` ids to one at most.  Only then are the chosen ids' texts read, by a join that
broadcasts those few ids, so no text is shuffled.  Of a text of more than ``max_chars``
characters one stretch of that length is learned from, which begins where a hash of
the doc_id says: every drawn id counts, however long its text.  An id of several labels counts by its least label;
of several texts, by the one of least hash.  Rows with a null id or label are not
learned from; an empty table gives no sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SALTS = 32
#: Modulus and remainder of the held-out fold.
FOLD = (5, 0)


def held_out(fold: tuple[int, int] = FOLD) -> Column:
    """crc32(doc_id as text) leaves the fold's remainder; a null doc_id is held out too."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold[0] == fold[1], F.lit(True))


def sample_keys(keys: DataFrame, label: str, per_class: int, fold: tuple[int, int] = FOLD) -> DataFrame:
    """doc_id, label of the rows to learn from: ``per_class`` ids of each class."""
    keys = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).filter(~held_out(fold) & F.col("label").isNotNull())
    drawn = keys.withColumns({"place": F.xxhash64("doc_id"), "salt": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS))})
    first = F.dense_rank().over(Window.partitionBy("label", "salt").orderBy("place", "doc_id"))
    near = drawn.withColumn("n", first).filter(F.col("n") <= per_class)
    ranked = near.withColumn("n", F.dense_rank().over(Window.partitionBy("label").orderBy("place", "doc_id"))).filter(F.col("n") <= per_class)
    return ranked.groupBy("doc_id").agg(F.min("label").alias("label"))


def labelled_sample(docs: DataFrame, keys: DataFrame, label: str, per_class: int, max_chars: int, fold: tuple[int, int] = FOLD) -> list[tuple[int, str, object]]:
    """(doc_id, text, label) of the sample, in an order that the doc_ids decide."""
    chosen = {r.doc_id: r.label for r in sample_keys(keys, label, per_class, fold).collect()}  # per_class rows a class
    if not chosen:
        return []
    ids = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in chosen], "doc_id long"))  # per_class ids a class
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null").join(ids, "doc_id")
    spare = F.greatest(F.length("text") - max_chars, F.lit(0))  # places where a stretch may begin, but the first
    rows = rows.withColumn("text", F.col("text").substr((F.pmod(F.xxhash64("doc_id", F.lit(2)), spare + 1) + 1).cast("int"), F.lit(max_chars)))
    found = rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.xxhash64("doc_id").alias("place")).collect()
    return [(r.doc_id, r.text, chosen[r.doc_id]) for r in sorted(found, key=lambda r: (r.place, r.doc_id))]
