"""Phrase matching over a table: every place of every listed phrase, one pass over the texts.

The phrases may be many: texts meet an automaton (functions/phrases.py), whose work does
not depend on their number.  It is sent to the tasks up to ``MAX_PHRASES`` phrases and
``MAX_BYTES`` bytes, counted first; more are dealt into parts of that size, and the
texts are read once for each part.  Places are handed on ``PLACES`` at a time: a task
holds those and one text's own, not those of a whole batch of texts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.phrases import PhraseMatcher
from ..sources.shared import arrow_rows

MAX_PHRASES, MAX_BYTES, PLACES = 500_000, 16 << 20, 50_000


def _placed(batch: pa.RecordBatch, matcher: PhraseMatcher, most: int = PLACES):
    """The places in a batch of (id, text) as batches of ``most`` rows at most."""

    def rows(at, found):
        columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array([matcher.phrases[p] for *_, p in found], pa.string()), pa.array([a for a, *_ in found], pa.int32()), pa.array([b for _, b, _ in found], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["id", "phrase", "start", "end"])

    at, found = [], []
    for i, t in enumerate(batch.column(1)):
        for place in matcher.find(t.as_py() or ""):
            at.append(i)
            found.append(place)
            if len(at) == most:
                yield rows(at, found)
                at, found = [], []
    yield rows(at, found)


def phrase_places(texts: DataFrame, phrases: DataFrame, key: str = "id", text: str = "text", phrase: str = "phrase", most: int = MAX_PHRASES) -> DataFrame:
    """key, phrase, start, end of every match (they may overlap); null texts and null or empty phrases have none."""
    spark = texts.sparkSession
    arrow_rows(spark)
    listed = phrases.select(F.col(phrase).cast("string").alias("phrase")).filter("trim(phrase) <> ''").distinct()
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.length("phrase") * 4), F.lit(0))).first()
    parts = max(1, -(-n // most), -(-size // MAX_BYTES))
    rows = texts.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def one(part: int) -> DataFrame:
        own = listed.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part) if parts > 1 else listed
        sent = spark.sparkContext.broadcast(PhraseMatcher(sorted(r.phrase for r in own.collect())))  # a part's bound

        def run(batches):
            for batch in batches:
                yield from _placed(batch, sent.value)

        return rows.mapInArrow(run, f"id {kind}, phrase string, start int, end int")

    out = one(0)
    for part in range(1, parts):
        out = out.unionByName(one(part))
    return out.withColumnRenamed("id", key)
