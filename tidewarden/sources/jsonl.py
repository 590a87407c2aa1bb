"""JSON-lines sources and sinks with counted bad rows, digests and a lock file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def read_batches(spark: SparkSession, folder: str, schema: str, skip_prefix: str = "review_") -> tuple[DataFrame, DataFrame]:
    """(rows with _file, bad rows): every *.jsonl but those of a prefix; bad lines are kept apart, not thrown."""
    full = f"{schema}, _corrupt_record string"
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(folder).filter(F.trim("value") != "")
    rows = lines.select(F.from_json("value", full, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("_file"))
    rows = rows.select("r.*", "_file").filter(~F.col("_file").startswith(skip_prefix))
    return rows.filter("_corrupt_record is null").drop("_corrupt_record"), rows.filter("_corrupt_record is not null").select("_file", "_corrupt_record")


def read_label_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only log: the last line of an id counts."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("n"))  # blocks of a file are read in any order, the lines of one in theirs
    lines = spark.read.text(path).select("value", place.alias("line_no")).filter(F.trim("value") != "")
    rows = lines.select(F.from_json("value", schema).alias("r"), "line_no").select("r.*", "line_no").filter("id is not null")
    w = Window.partitionBy("id").orderBy(F.desc("line_no"))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "line_no")


def covering(cache: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame | None:
    """Cached rows in the order wanted (column ordinal), or None unless every id is covered."""
    if not wanted.join(cache.select(key), key, "left_anti").isEmpty():
        return None
    return wanted.select(key, "ordinal").join(cache, key).orderBy("ordinal")


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per run and epoch from */metrics.json, crashed runs left out."""
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "metrics.json").json(root)
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.select(run.alias("run"), F.explode("epochs").alias("e")).filter(~F.col("run").contains("crashed")).select("run", "e.*")


def read_run_configs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """One row per run from */config.json, with the fields asked for; runs without one have no row."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "config.json").json(root)
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run"), "*")


def read_epoch_items(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Per-item rows of every epoch from */epoch-N*.jsonl, with run and epoch."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "epoch-*.jsonl").json(root)
    path = F.split(F.col("_metadata.file_path"), "/")
    return rows.select(F.element_at(path, -2).alias("run"), F.regexp_extract(F.element_at(path, -1), r"^epoch-(\d+)", 1).cast("int").alias("epoch"), "*")


def digest(df: DataFrame, key: str) -> str:
    """SHA-256 that depends on the rows and not on their order or files: sums of the row hashes' parts, and the count, hashed.

    Sums of 48-bit parts are added up as decimals, map-side first; nothing but five numbers a task is moved.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.sum(F.conv(F.substring("h", 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(5)]
    sums = df.select(row.alias("h")).agg(F.count("*").alias("n"), *parts)
    return sums.select(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in sums.columns]), 256).alias("d")).first()["d"]


FROZEN = "test"


def write_split(df: DataFrame, folder: str, name: str, key: str = "id", frozen_ok: bool = False) -> str:
    """Write a split as JSON lines (not over an existing one); returns its digest."""
    if name == FROZEN and not frozen_ok:
        raise ValueError("the frozen split is written by freeze_split only")
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(f"{folder}/{name}")
    return digest(df, key)


def write_splits(items: DataFrame, folder: str, key: str = "id", group: str = "seed_group") -> dict[str, int]:
    """Write the rows of train and dev (column split) as JSON lines in one job that guards them: rows by split.

    A repeated id, or a group in both splits, makes the tasks that write fail, so nothing
    is committed; the counts are observed by the same job.  Rows of other splits are not
    written, but their ids count.  A null group is no group.
    """
    kept = F.col("split").isin("train", "dev")
    of_group = Window.partitionBy(group)
    side = F.when(kept, F.col("split"))
    once = F.count("*").over(Window.partitionBy(key)) == 1
    apart = F.col(group).isNull() | F.coalesce(F.min(side).over(of_group) == F.max(side).over(of_group), F.lit(True))
    sound = F.when(~once, F.raise_error(F.concat(F.lit("repeated id "), F.col(key).cast("string"))).cast("boolean")).when(~apart, F.raise_error(F.concat(F.lit("group in both splits: "), F.col(group).cast("string"))).cast("boolean")).otherwise(True)
    seen = Observation()
    rows = items.withColumn("_sound", sound).filter("_sound").drop("_sound").filter(kept).observe(seen, F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "dev").alias("dev"))
    rows.write.mode("errorifexists").option("ignoreNullFields", False).partitionBy("split").json(folder)
    return dict(seen.get)


def lock_with(lock: dict, entries: dict) -> dict:
    """New entries over old ones; an entry of the frozen split stays."""
    return {**lock, **entries, **({FROZEN: lock[FROZEN]} if FROZEN in lock else {})}


def freeze_split(df: DataFrame, folder: str, lock: dict, key: str = "id", force: bool = False) -> dict:
    """Write the frozen split once; when forced, the other splits' lock entries are stale and go."""
    if FROZEN in lock and not force:
        raise ValueError("the frozen split exists")
    df.write.mode("overwrite" if force else "errorifexists").json(f"{folder}/{FROZEN}")
    kept = {k: v for k, v in lock.items() if k not in ("train", "dev")} if force else lock
    return {**kept, FROZEN: {"sha256": digest(df, key), "n": df.count()}}


def guard_split(split: str, allowed=("dev",), test_ok: bool = False) -> str:
    if split == FROZEN and not test_ok:
        raise PermissionError("the test split needs an explicit flag")
    if split not in (*allowed, FROZEN):
        raise ValueError(f"unknown split {split}")
    return split


def write_results(metrics: dict, items: DataFrame, folder: str, private=("text", "quotes", "gold_quotes", "pred_quotes", "explanation")) -> None:
    """Metrics as one JSON row and per-item rows without any message text."""
    spark = items.sparkSession
    spark.createDataFrame([(json.dumps(metrics, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metrics")
    items.drop(*private).write.mode("overwrite").json(f"{folder}/items")


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key is not stored yet: a rerun adds nothing twice."""
    spark = df.sparkSession
    try:
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
    df.write.mode("append").parquet(path)
