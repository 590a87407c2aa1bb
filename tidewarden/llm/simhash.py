"""Operator 4: SimHash near-duplicates by multi-index hashing.

Fingerprint: 64 bits over the XXH64 values of a text's 3-word shingles (words are
runs of anything but ASCII white space, A-Z lower-cased).  Two fingerprints link
at 3 or fewer differing bits.

Search: a fingerprint has two 32-bit segments.  If two fingerprints differ in at
most 3 bits, some segment differs in at most 1, so the Hamming balls to enumerate
have radius 1: every distinct fingerprint enters each segment's table under the
segment's value, and probes the values with one more bit set (the pair is found
from the side that lacks the bit).  Table and probes meet by key; whole distances
are verified.

Copies are merged first (one row per distinct fingerprint, pre-aggregated).  Per
key only the edges of a spanning forest are emitted, so a crowded key costs no
pair rows.  A key of more than ``HOT`` table entries is dealt over pairs of
blocks: every two of its members still meet in some block pair.  Components are
found in Spark (see components.py).

Documents without words (null, empty, white space) have fingerprint 0 and link like
any other.  A class's id is its smallest non-null doc_id (null if it has none).
Repeated rows stay.  A very long text is hashed whole, its bits counted in slices.
Other columns, whatever their names, take no part; ``keep_first`` hands them on.  An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .forced_bpe import release
from .storage import arrow_rows, materialise, quoted

RADIUS = 3
WORDS = 3
SEED = 42
#: Table entries of one key that one task takes; more are dealt over block pairs.
HOT = 4096


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(WORDS, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, mark (XXH64 of the text), fingerprint (the 64 bits as a signed long)."""

    def run(batches):
        release()
        for batch in batches:
            values = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], ["doc_id", "mark", "fingerprint"])

    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, mark long, fingerprint long")


def forest(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the values within ``radius`` bits of each other.

    Breadth first: a value is compared with those not reached yet only.
    """
    rest = np.unique(values)
    left, right = [], []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.bitwise_count(front[:64, None] ^ rest[None, :]) <= radius
            hit = near.any(0)
            reached = rest[hit]
            left.append(front[:64][near[:, hit].argmax(0)])
            right.append(reached)
            rest, front = rest[~hit], np.concatenate([front[64:], reached])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _keyed(distinct: DataFrame) -> DataFrame:
    """Rows (seg, key, probe, fp): each table entry and each probe of its balls."""

    def row(seg: int, value, probe: bool):
        return F.struct(F.lit(seg).cast("byte").alias("seg"), value.alias("key"), F.lit(probe).alias("probe"))

    def of_segment(seg: int):
        value = F.shiftrightunsigned("fp", 32 * seg).bitwiseAND(F.lit(0xFFFFFFFF))
        flips = F.expr(f"transform(filter(sequence(0, 31), b -> bit_get(fp, b + {32 * seg}) = 0), b -> shiftleft(1L, b))")
        return F.array_append(F.transform(flips, lambda x: row(seg, value.bitwiseOR(x), True)), row(seg, value, False))

    entries = [of_segment(0), of_segment(1)]
    return distinct.select("fp", F.explode(F.concat(*entries)).alias("k")).select("k.seg", "k.key", "k.probe", "fp")


def _edges_by_key(batches):
    """Spanning-forest edges of every key's run; rows come sorted by seg, key, unit."""
    held: list[np.ndarray] | None = None

    def edges(cols):
        seg, key, unit, probe, fp = cols
        starts = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])]))
        sizes = np.diff(np.append(starts, len(seg)))
        tables = np.add.reduceat((~probe).astype(np.int64), starts)
        a, b = [], []
        for i in np.flatnonzero((sizes > 1) & (tables > 0)):
            x, y = forest(fp[starts[i] : starts[i] + sizes[i]])
            a.append(x)
            b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        cols[4] = cols[4].view(np.uint64)
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        seg, key, unit = cols[:3]
        last = (seg == seg[-1]) & (key == key[-1]) & (unit == unit[-1])
        cut = len(seg) - int(last.sum())
        if cut:
            yield from edges([c[:cut] for c in cols])
        held = [c[cut:] for c in cols]
    if held is not None:
        yield from edges(held)


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all within the radius."""
    keyed = _keyed(distinct)
    table_keys = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(s).cast("byte").alias("seg"), F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")) for s in (0, 1)])).alias("k"))
    crowded = materialise(table_keys.groupBy("k.seg", "k.key").count().filter(F.col("count") > hot).select("seg", "key", F.ceil(F.col("count") / hot).cast("int").alias("blocks")), "hot-keys")
    if crowded.isEmpty():
        rows = keyed.withColumn("unit", F.lit(0).cast("long"))
    else:
        rows = keyed.join(crowded, ["seg", "key"], "left")
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("long")
        units = F.expr("transform(sequence(0, blocks - 1), j -> cast(least(mine, j) as long) * blocks + greatest(mine, j))")
        rows = rows.withColumn("mine", block).withColumn("unit", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(units)))
    rows = rows.select("seg", "key", "unit", "probe", "fp").repartition("seg", "key", "unit").sortWithinPartitions("seg", "key", "unit")
    return rows.mapInArrow(_edges_by_key, "a long, b long").distinct()


def classes(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """fingerprint, label (one fingerprint of its class), first (smallest doc_id of the fingerprint)."""
    distinct = materialise(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    labels = connected_components(links(distinct, hot)).withColumnRenamed("node", "fp")
    found = distinct.join(labels, "fp", "left").select(F.col("fp").alias("fingerprint"), F.coalesce("label", "fp").alias("label"), "first")
    return materialise(found, "classes")


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    prints = materialise(fingerprints(docs), "fingerprints")
    found = classes(prints, hot)
    names = found.groupBy("label").agg(F.min("first").alias("component_id"))
    return prints.join(found.join(names, "label").select("fingerprint", "component_id"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row of each class: that of the smallest doc_id (nulls last), ties by a hash of the text.

    The rows' ids and hashes alone go through the search; the texts are shuffled once,
    for the last join.  The caller's columns travel in one struct, so no name of theirs
    can clash with those used here.
    """
    prints = materialise(fingerprints(docs), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    per_print = prints.groupBy("fingerprint").agg(F.min(row).alias("row"))
    kept = classes(prints, hot).join(per_print, "fingerprint").groupBy("label").agg(F.min("row").alias("row"))
    key = lambda doc_id, mark: [F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("none"), mark.alias("own")]
    names = ["id", "none", "own"]  # plain columns: the window below finds the join's partitions as it needs them
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("whole"), *key(F.col("doc_id").cast("long"), F.xxhash64("text")))
    found = rows.join(kept.select(*key(F.col("row.doc_id"), F.col("row.mark"))), names, "left_semi")
    once = Window.partitionBy(*names).orderBy(F.lit(1))
    return found.withColumn("n", F.row_number().over(once)).filter("n = 1").select("whole.*")
