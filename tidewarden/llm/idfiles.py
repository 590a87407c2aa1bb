"""Operator 6: token-id files with Elias-Fano document boundaries.

Documents are range-partitioned by doc_id (the text is shuffled once, before
tokenising, so sampling the range costs no tokenising), sorted, encoded and
written as shards of bounded size.  A file holds

====================  =====================================================
header (40 bytes)     magic, id width, documents n, ids U, least doc_id, null doc_ids
doc ids               Elias-Fano sequence of doc_id - least, nulls (which sort first) left out
boundaries            Elias-Fano sequence of the n + 1 places where documents begin
ids                   all ids end to end, 2 bytes each where they fit, else 4
====================  =====================================================

and a sequence holds

====================  =====================================================
header (32 bytes)     values, low-bit width l, bytes of the low and of the high section
low section           the l low bits of every value, packed
high section          unary code of the values' high parts, a bit set
select samples        uint32: place of every 256th one-bit of the high section
====================  =====================================================

so a value takes about l + 2 bits instead of 64.  ``select`` finds one value from the
nearest sample; ``stretch`` decodes the values from one select on, a few hundred at a
time, so a reader never holds a table of 64-bit offsets.  One document's ids are fetched
by seeking.

A task writes under a name of its attempt and renames when whole, so repeated or
speculative attempts leave one good file.  The manifest (one row per file) is a
written table; the number of ids before each file is summed in Spark, over the files
of a writing task and over the tasks.

Null doc_ids sort first.  Rows of one doc_id (or of none) are split over tasks by a
hash of their text and keep any order among themselves; repeated rows are written as
often as they occur.  Null and empty texts are the end id alone; a very long text is
one run of ids that closes its file.  Other columns, whatever their names, take no
part.  An empty table gives an empty manifest, no files and no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .forced_bpe import DEFAULT_VOCABULARY, encoder
from .storage import arrow_rows, materialise, new_path
from .tokens import slices

MAGIC = b"TWEFIDS2"
_HEADER = struct.Struct("<8sIIQqQ")
_SEQUENCE = struct.Struct("<QQQQ")
#: Documents handed on at once by a reader.
DOCUMENTS = 500
SAMPLE = 256
#: Bytes of the high section counted at a time.
STEP = 4096
END_ID = 2
#: Bytes of ids after which a task starts another file.
SHARD_BYTES = 16 << 20


def elias_fano(values) -> tuple[int, bytes, bytes, np.ndarray]:
    """Of a non-decreasing sequence: low-bit width, low section, high section, samples."""
    values = np.asarray(values).astype(np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    high[places] = 1
    return low, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4")


class Boundaries:
    """Elias-Fano sequence of ``n`` values with select and streaming decoding."""

    def __init__(self, n: int, low: int, low_bytes: bytes, high_bytes: bytes, samples: np.ndarray):
        self.n, self.low, self.samples = n, low, samples
        self.low_bits = np.frombuffer(low_bytes, np.uint8)
        self.high = np.frombuffer(high_bytes, np.uint8)

    def _place(self, i: int) -> int:
        """Place of one-bit i of the high section, found from the sample at or before it.

        Whole windows of bytes are counted and passed by until the one that holds the bit,
        however long the gap (a very long document leaves as many zero bits).
        """
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        bits = int(self.high[byte]) >> (at % 8) << (at % 8)  # from the sampled bit on
        if left >= bits.bit_count():
            left -= bits.bit_count()
            byte += 1
            while True:
                counts = np.cumsum(np.bitwise_count(self.high[byte : byte + STEP]), dtype=np.int64)
                if not len(counts):
                    raise ValueError("the high section ends before its last one-bit")
                if left < counts[-1]:
                    break
                left -= int(counts[-1])
                byte += len(counts)
            k = int(np.searchsorted(counts, left, side="right"))
            left -= int(counts[k - 1]) if k else 0
            byte += k
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        return byte * 8 + (bits & -bits).bit_length() - 1

    def _lows(self, i: int, count: int) -> np.ndarray:
        first = i * self.low
        own = np.unpackbits(self.low_bits[first // 8 : (first + count * self.low + 7) // 8], bitorder="little")
        bits = own[first % 8 : first % 8 + count * self.low].reshape(count, self.low)
        return (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Value ``i``."""
        return ((self._place(i) - i) << self.low) | int(self._lows(i, 1)[0])

    def stretch(self, i: int, count: int) -> np.ndarray:
        """Values i to i + count - 1 (uint64): one select, then the one-bits that follow, window by window."""
        if count <= 0:
            return np.zeros(0, np.uint64)
        self._place(i + count - 1)  # in range
        start = self._place(i)
        found, have, byte = [], 0, start // 8
        while have < count:
            bits = np.flatnonzero(np.unpackbits(self.high[byte : byte + STEP], bitorder="little")) + byte * 8
            bits = bits[bits >= start]
            found.append(bits)
            have += len(bits)
            byte += STEP
        highs = np.concatenate(found)[:count] - np.arange(i, i + count)
        return (highs.astype(np.uint64) << np.uint64(self.low)) | self._lows(i, count)

def sequence_bytes(values) -> bytes:
    low, lows, highs, samples = elias_fano(values)
    return b"".join([_SEQUENCE.pack(len(values), low, len(lows), len(highs)), lows, highs, samples.tobytes()])


def read_sequence(handle) -> Boundaries:
    n, low, n_low, n_high = _SEQUENCE.unpack(handle.read(_SEQUENCE.size))
    lows, highs = handle.read(n_low), handle.read(n_high)
    return Boundaries(n, low, lows, highs, np.frombuffer(handle.read(4 * -(-n // SAMPLE)), "<u4"))


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """``doc_ids`` rise, nulls first."""
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    named = [d for d in doc_ids if d is not None]
    least = named[0] if named else 0
    header = _HEADER.pack(MAGIC, width, len(doc_ids), int(ends[-1]), least, len(doc_ids) - len(named))
    return b"".join([header, sequence_bytes(np.array([d - least for d in named], np.uint64)), sequence_bytes(ends), ids])


class IdFile:
    """Reader of one file: the two sequences are loaded as they are stored, ids are sought."""

    def __init__(self, handle):
        self.handle = handle
        magic, self.width, self.n, self.total, self.least, self.n_null = _HEADER.unpack(handle.read(_HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        self.names, self.boundaries = read_sequence(handle), read_sequence(handle)
        self.ids_at = handle.tell()

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        """Of documents ``first`` up to ``last``."""
        nulls = max(0, min(last, self.n_null) - first)
        begin = max(first, self.n_null) - self.n_null
        return [None] * nulls + [self.least + v for v in self.names.stretch(begin, max(0, last - max(first, self.n_null))).tolist()]

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids from boundary ``first`` up to boundary ``last`` as uint32."""
        a, b = self.boundaries.select(first), self.boundaries.select(last)
        self.handle.seek(self.ids_at + a * self.width)
        return np.frombuffer(self.handle.read((b - a) * self.width), f"<u{self.width}").astype("<u4")


def write_id_files(docs: DataFrame, folder: str, vocabulary: str = DEFAULT_VOCABULARY, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the files; returns the manifest: shard, path, n_docs, n_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        enc, task = encoder(vocabulary), TaskContext.get()
        width = enc.dtype.itemsize
        end = np.array([end_id], enc.dtype).tobytes()
        names: list = []
        lengths: list[int] = []
        chunks: list[bytes] = []
        held, k = 0, 0

        def close():
            nonlocal names, lengths, chunks, held, k
            store, root = fs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            final = f"{root}/shard-{task.partitionId():06d}-{k:04d}.efids"
            own = f"{root}/_attempt-{task.taskAttemptId()}-{k:04d}"
            with store.open_output_stream(own) as f:
                f.write(file_bytes(names, lengths, b"".join(chunks), width))
            store.move(own, final)
            row = [[(task.partitionId() << 20) | k], [final.removeprefix(root + "/")], [len(names)], [sum(lengths)]]
            names, lengths, chunks, held, k = [], [], [], 0, k + 1
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1]), pa.array(row[2], pa.int64()), pa.array(row[3], pa.int64())], ["shard", "path", "n_docs", "n_ids"])

        for batch in slices(batches):
            for name, raw in zip(batch.column(0).to_pylist(), enc.encode_batch(batch.column(1).to_pylist())):
                names.append(name)
                lengths.append(len(raw) // width + 1)
                chunks += [raw, end]
                held += len(raw) + width
                if held >= shard_bytes:
                    yield close()
        if names:
            yield close()

    spark = docs.sparkSession
    arrow_rows(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    return materialise(ordered.mapInArrow(run, "shard long, path string, n_docs long, n_ids long"), "id-manifest")


def read_id_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Documents as the files hold them: doc_id, start, n_tokens, ids (uint32 bytes)."""
    task = F.shiftright("shard", 20).alias("task")
    earlier = lambda by: F.coalesce(F.sum("n_ids").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = manifest.groupBy(task).agg(F.sum("n_ids").alias("n_ids")).select("task", earlier(Window.orderBy("task")).alias("before"))  # one row per writing task
    within = manifest.select("path", task, earlier(Window.partitionBy(F.shiftright("shard", 20)).orderBy("shard")).alias("own"))
    listed = within.join(tasks, "task").select("path", (F.col("own") + F.col("before")).alias("base"))
    n_files = manifest.count()

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{root}/{path}") as handle:
                    f = IdFile(handle)
                    for at in range(0, f.n, DOCUMENTS):
                        to = min(f.n, at + DOCUMENTS)
                        bounds = f.boundaries.stretch(at, to + 1 - at).astype(np.int64)
                        flat, b = f.ids(at, to).tobytes(), bounds - bounds[0]
                        ids = [flat[4 * x : 4 * y] for x, y in zip(b.tolist(), b[1:].tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(f.doc_ids(at, to), pa.int64()), pa.array(base + bounds[:-1], pa.int64()), pa.array(np.diff(b), pa.int64()), pa.array(ids, pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )

    return listed.repartition(max(1, min(n_files, 10_000)), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def new_folder(spark: SparkSession) -> str:
    return new_path(spark, "token-ids")
