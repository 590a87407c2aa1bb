"""Corpus pipeline: quality, language, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep
the columns of ``documents``.  The classifiers are fitted on the labelled rows of
sf_dir and judge every row they are given.

1. quality: documents scoring under the classifier's threshold go.
2. language: documents without a predicted language (no letter, null text) or with a
   calibrated probability under ``MIN_LANGUAGE_SCORE`` go.
3. near_duplicates: of each group of linked fingerprints the document of the smallest
   doc_id stays (rows without one come last; of rows repeated whole, one).
4. secrets: secrets are masked in the text and n_chars follows; every document stays.
5. packing: the sequences, one row per placed piece.

Rows are handed on whole: columns of any name (those that clash with names used
inside, names with dots) come out as they went in.  Null texts score as empty ones in
1 and have no language, so they go in 2 at the latest; very long texts are read whole;
repeated rows stay until 3 keeps one of them; an empty table passes every stage and
packs into nothing.

There is no SQL for a stage that runs a learned model, so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm import bytecnn, language, packing, secrets, simhash
from tidewarden.llm.storage import materialise, table

MIN_LANGUAGE_SCORE = 0.35
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bytecnn.keep_good(docs, bytecnn.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs, language.fit(table(spark, sf_dir, "documents")), MIN_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.mask_secrets(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality classifier", quality), ("language ID", languages), ("SimHash near-dedup", near_duplicates), ("secret scans", mask_secrets), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
