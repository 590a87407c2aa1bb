"""The shared-folder helpers of the library, and the tables' reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import ARROW_ROWS, arrow_rows, materialise, new_path, shared_dir

__all__ = ["ARROW_ROWS", "arrow_rows", "map_rows", "materialise", "new_path", "quoted", "shared_dir", "table"]


def quoted(names) -> list[str]:
    """Column names as Spark reads them whatever characters they hold."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def map_rows(rows: DataFrame, run) -> DataFrame:
    """``mapInArrow`` of whole rows to whole rows of the same columns, whatever characters their names hold."""
    plain = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*rows.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
