"""The queries of this subpackage: opN_<name> applies operator N to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytecnn, curves, idfiles, impacts, language, licences, packing, quality_rules, secrets, simhash, tokens, toxicity, whitening
from .oracle import quality_rules_sql, ranked_search_sql
from .storage import table


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(licences.scan_licences(table(spark, sf_dir, "documents")))


def op2_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def op3_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digests(tokens.encode_documents(table(spark, sf_dir, "documents")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = idfiles.new_folder(spark)
    manifest = idfiles.write_id_files(table(spark, sf_dir, "documents"), folder)
    back = idfiles.read_id_files(spark, folder, manifest)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytecnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whiten(table(spark, sf_dir, "embeddings")))


QUERIES = {f.__name__: f for f in (op1_licences, op2_hilbert_neighbours, op3_forced_bpe, op4_simhash, op5_packing, op6_id_files, op7_quality_rules, op8_secrets, op9_language, op10_byte_cnn, op11_toxicity, op12_impact_search, op13_whitening)}
ORACLE_SQL: dict[str, str] = {"op7_quality_rules": quality_rules_sql(), "op12_impact_search": ranked_search_sql()}
