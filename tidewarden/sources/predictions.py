"""A Spark data source of per-item predictions: JSON lines below a folder, read by planned partitions, written with a commit.

``spark.read.format("predictions").schema(...).load(folder)`` reads the files that committed writes
named, a partition for each ``SPLIT`` bytes of whole lines; ``write.format("predictions").mode("append").save(folder)``
has every task write a file of its own and the driver name them all at once, so a
failed or repeated task leaves nothing that a reader sees.  Lines carry their place
(``_write``, ``_line``), by which ``last_of`` keeps the last row of each id.

Columns are strings, numbers, booleans and arrays of these, by the schema asked for; a field
that a line lacks is null.  ``load`` of a folder without a commit has no rows.
"""

from __future__ import annotations

import io
import json
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SPLIT = 32 << 20
#: Columns of text that no prediction file carries.
PRIVATE = ("text", "quotes", "gold_quotes", "pred_quotes", "explanation")


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else f"file://{folder}")


class Piece(InputPartition):
    def __init__(self, path: str, start: int, stop: int, write: int):
        super().__init__((path, start, stop, write))


class Named(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class PredictionReader(DataSourceReader):
    def __init__(self, schema: StructType, folder: str):
        self.schema, self.folder = schema, folder

    def partitions(self):
        from pyarrow import fs

        store, root = _store(self.folder)
        listed = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        pieces = []
        for n, name in enumerate(sorted(f.base_name for f in listed if f.base_name.startswith("_commit-"))):
            with store.open_input_stream(f"{root}/{name}") as f:
                files = json.loads(f.read())["files"]
            for path in files:
                size = store.get_file_info(f"{root}/{path}").size
                pieces += [Piece(path, at, min(at + SPLIT, size), n) for at in range(0, size, SPLIT)]
        return pieces or [Piece("", 0, 0, 0)]

    def read(self, partition) -> Iterator[tuple]:
        path, start, stop, write = partition.value
        if not path:
            return
        store, root = _store(self.folder)
        names = self.schema.fieldNames()
        with io.BufferedReader(store.open_input_file(f"{root}/{path}"), 1 << 20) as f:
            at = max(start - 1, 0)
            f.seek(at)
            if start:  # the line that goes on over the border belongs to the piece before
                at += len(f.readline())
            while at < stop:
                line = f.readline()
                if not line:
                    return
                if line.strip():
                    row = {**json.loads(line), "_write": write, "_line": f"{path}:{at:015d}"}
                    yield tuple(row.get(k) for k in names)
                at += len(line)


class PredictionWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator) -> WriterCommitMessage:
        store, root = _store(self.folder)
        name, out = f"part-{uuid.uuid4().hex}.jsonl", None
        for row in iterator:
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}")
            out.write(json.dumps({k: v for k, v in row.asDict(recursive=True).items() if k not in PRIVATE}, ensure_ascii=False).encode() + b"\n")
        if out is None:
            return Named(None)
        out.close()
        return Named(name)

    def commit(self, messages) -> None:
        store, root = _store(self.folder)
        store.create_dir(root, recursive=True)
        own = f"{root}/.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as f:
            f.write(json.dumps({"files": sorted(m.name for m in messages if m and m.name)}).encode())
        store.move(own, f"{root}/_commit-{time.time_ns():020d}")

    def abort(self, messages) -> None:
        store, root = _store(self.folder)
        for m in messages:
            if m and m.name:
                store.delete_file(f"{root}/{m.name}")


class Predictions(DataSource):
    @classmethod
    def name(cls) -> str:
        return "predictions"

    def schema(self) -> str:
        return "id string, _write int, _line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PredictionReader(schema, self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("predictions are appended; a new set has a folder of its own")
        return PredictionWriter(self.options["path"])


def write_predictions(rows: DataFrame, folder: str) -> None:
    """Append the rows in one commit, without columns of text."""
    rows.sparkSession.dataSource.register(Predictions)
    rows.drop(*PRIVATE).write.format("predictions").mode("append").save(folder)


def read_predictions(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The committed rows with their places."""
    spark.dataSource.register(Predictions)
    return spark.read.format("predictions").schema(f"{schema}, _write int, _line string").load(folder)


def last_of(rows: DataFrame, key: str = "id") -> DataFrame:
    """The last row of each id: of the latest write, and in one write of the last line in order of its files."""
    newest = Window.partitionBy(key).orderBy(F.desc("_write"), F.desc("_line"))
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "_write", "_line")


def for_ids(cache: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """The cached row of every id wanted, with its ordinal; an id without one is an error when the rows are read.

    One join tells both, so the check costs no pass of its own.
    """
    rows = wanted.select(key, "ordinal").join(cache.withColumn("_here", F.lit(True)), key, "left")
    return rows.filter(F.coalesce("_here", F.raise_error(F.concat(F.lit("no prediction for id "), F.col(key).cast("string"))).cast("boolean"))).drop("_here")
