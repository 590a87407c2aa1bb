"""Shared-folder helpers: where intermediate tables and output files go.

Everything that outlives one stage is written below the folder the cluster names in
``spark.checkpoint.dir``.  Only a local master (tests, notebooks), where driver and
executors are one process, may leave it unset; it gets a folder of its own.  On a
cluster an unset folder is an error: no other place is seen by all executors.  No
local checkpoint is ever taken.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows per Arrow batch handed to Python: documents can be long, so batches stay small.
ARROW_ROWS = 1000
_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Root of the shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidewarden-")
    return _OWN[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_written(spark: SparkSession) -> int:
    """Delete what this session has written to paths of new_path(); how many there were.

    Frames still to be read may stand on them, so it is for the caller to say when:
    after a query's result is written.
    """
    gone = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in gone:
        own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)
    return len(gone)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows`` unless it is lower already.

    It stays so, as frames are read later; a smaller batch changes no result.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
