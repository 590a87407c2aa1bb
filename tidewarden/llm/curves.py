"""Operator 2: approximate nearest neighbours by shifted space-filling curves.

Copies of a vector are merged first (the ``k + 1`` smallest ids of each are all
that a top-k list can need); a distinct vector goes by the smallest of its ids.  Each
of ``CURVES`` orderings projects the vectors on ``DIMS`` random orthonormal
directions, maps them to the unit cube by the normal distribution function of a
bounded sample, shifts the cube at random and takes the Hilbert index.  Spark
range-partitions the rows by (curve, index); the sorted runs give every vector a
rank per curve.

A query's candidates are the vectors within ``window`` ranks on any curve.  The
window is fitted, not fixed: for a bounded sample of queries the true neighbours
are found by one linear pass, and the least window that would reach ``TARGET`` of
them is taken for all.  Blocks of consecutive ranks meet the queries whose windows
touch them, exact distances are computed there in double precision, and the lists
are merged and reranked.  A block asked by more than ``QUERY_DEAL`` queries is dealt
over as many tasks as that takes; no other rows are copied.

Ties: everywhere rows are cut by (exact distance, smallest id of the vector), and the
rough distances that spare most exact ones are cut with their rounding error, so
among equal distances found the smaller vec_ids are listed.

Vectors null, empty, zero or with null or non-finite components take no part, nor
do those of another length than the commonest (ties: the longer).  A null id takes
no part.  Rows repeated whole count once.  Other columns, whatever their names, take
no part.  No usable vectors, or no query: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import arrow_rows, materialise

CURVES = 8
DIMS = 4
BITS = 12
BLOCK = 2048
TARGET = 0.95
FIT_QUERIES = 64
FIT_ROWS = 4096
#: Queries that one task takes against a block; a block asked by more is dealt over several tasks.
QUERY_DEAL = 100_000
#: Exact distances computed at once.
PAIRS = 1 << 15


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows) by the transpose method of Skilling (2004)."""
    axes = [c.astype(np.int64) for c in cells.T]
    n, q = len(axes), 1 << (bits - 1)
    while q > 1:
        mask = q - 1
        for i in range(n):
            on = (axes[i] & q) != 0
            swap = np.where(on, 0, (axes[0] ^ axes[i]) & mask)
            axes[0] = np.where(on, axes[0] ^ mask, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
        q >>= 1
    for i in range(1, n):
        axes[i] = axes[i] ^ axes[i - 1]
    fix, q = np.zeros_like(axes[0]), 1 << (bits - 1)
    while q > 1:
        fix = np.where((axes[-1] & q) != 0, fix ^ (q - 1), fix)
        q >>= 1
    out = np.zeros_like(axes[0])
    for b in range(bits - 1, -1, -1):
        for a in axes:
            out = (out << 1) | (((a ^ fix) >> b) & 1)
    return out


def _normal_share(z: np.ndarray) -> np.ndarray:
    return np.frompyfunc(lambda x: 0.5 * (1 + math.erf(x * 0.7071067811865476)), 1, 1)(z).astype(float) if z.size else z


class Curves:
    """The fitted orderings: directions, centre, spread and shift of each."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, seed: int = 11):
        rng, width = np.random.default_rng(seed), sample.shape[1]
        dims = min(dims, width)
        self.bits = min(BITS, 62 // dims)
        self.maps = []
        for _ in range(curves):
            directions = np.linalg.qr(rng.normal(size=(width, width)))[0][:, :dims]
            z = sample @ directions
            spread = z.std(0)
            self.maps.append((directions, z.mean(0), np.where(spread > 0, spread, 1.0), rng.random(dims) / 2))

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        directions, centre, spread, shift = self.maps[curve]
        share = _normal_share((x @ directions - centre) / spread) / 2 + shift
        return hilbert_index(np.minimum((share * (1 << self.bits)).astype(np.int64), (1 << self.bits) - 1), self.bits)


def _matrix(column, width: int) -> np.ndarray:
    """A binary column of float64 vectors as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width)


def _clean(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, vec (array<double>): the rows that take part, and their length."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    width = common["n"] if common else 0
    return rows.filter(F.size("vec") == width), width


def _pack(batches):
    for b in batches:
        flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0
        size = 8 * len(flat) // max(b.num_rows, 1)
        raw = flat.tobytes()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[i * size : (i + 1) * size] for i in range(b.num_rows)], pa.binary())], ["vec_id", "vec"])


def _nearest_rows(q: np.ndarray, x: np.ndarray, names: np.ndarray, centre: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, row of x, exact distance) of the ``keep`` first rows of every query by (distance, name).

    Rough distances from the centre choose the rows measured exactly: all within their
    rounding error of the ``keep``-th.
    """
    u, v = q - centre, x - centre
    sizes, own = (v * v).sum(1), (u * u).sum(1)
    rough = sizes[None, :] - 2 * (u @ v.T)
    few = min(len(x), keep)
    error = (own + sizes.max()) * (x.shape[1] + 8) * 1e-15
    rows, cols = np.nonzero(rough <= (np.partition(rough, few - 1, axis=1)[:, few - 1] + error)[:, None])
    exact = np.concatenate([np.zeros(0), *(np.sqrt(((q[rows[i : i + PAIRS]] - x[cols[i : i + PAIRS]]) ** 2).sum(1)) for i in range(0, len(rows), PAIRS))])
    order = np.lexsort((names[cols], exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    near = np.arange(len(rows)) - np.searchsorted(rows, rows) < keep
    return rows[near], cols[near], exact[near]


def nearest(vectors: DataFrame, is_query, k: int = 10, curves: int = CURVES, dims: int = DIMS, target: float = TARGET, block: int = BLOCK, deal: int = QUERY_DEAL) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every query row.

    ``is_query`` is a condition on vec_id.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    arrow_rows(spark)
    clean, width = _clean(vectors)
    if not width:
        return spark.createDataFrame([], schema)
    packed = clean.mapInArrow(_pack, "vec_id long, vec binary")
    # copies of one vector: its k + 1 smallest ids, limited before they are shuffled
    smallest = Window.partitionBy("vec").orderBy("vec_id")
    ids = packed.withColumn("n", F.dense_rank().over(smallest)).filter(F.col("n") <= k + 1).distinct()
    asked = packed.filter(is_query).select("vec", F.lit(True).alias("asked")).distinct()
    own = ids.groupBy("vec").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).join(asked, "vec", "left")
    distinct = materialise(own.select(F.get("ids", F.lit(0)).alias("key"), "vec", "ids", F.coalesce("asked", F.lit(False)).alias("asked")), "vectors")
    n = distinct.count()

    def sample(rows: DataFrame, size: int) -> list:
        share = min(1.0, 2 * size / max(rows.count(), 1))
        drawn = F.xxhash64("key")
        return rows.filter(F.pmod(drawn, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(drawn, "key").limit(size).collect()

    drawn = np.frombuffer(b"".join(bytes(r.vec) for r in sample(distinct.select("key", "vec"), FIT_ROWS)), "<f8").reshape(-1, width)
    fitted, middle = Curves(drawn, curves, dims), drawn.mean(0)

    def on_curves(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), width)
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(fitted.keys(x, c)), *b.columns], ["curve", "place", "key", "vec", "asked"])

    def number(batches):
        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for b in batches:
            curve = b.column(0).to_numpy()
            pos = np.zeros(len(curve), np.int64)
            for c in np.unique(curve).tolist():
                hit = curve == c
                pos[hit] = seen.get(c, 0) + np.arange(int(hit.sum()))
                seen[c] = seen.get(c, 0) + int(hit.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(curve), part, np.int32)), pa.array(pos), *b.columns[2:]], ["curve", "part", "pos", "key", "vec", "asked"])

    kind = "key long, vec binary, asked boolean"
    laid = distinct.drop("ids").mapInArrow(on_curves, f"curve int, place long, {kind}").repartitionByRange("curve", "place", "key").sortWithinPartitions("curve", "place", "key")
    laid = materialise(laid.mapInArrow(number, f"curve int, part int, pos long, {kind}"), "curves")
    # rows before each partition's run of a curve: one number per (partition, curve)
    counts = laid.groupBy("curve", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = laid.join(materialise(counts.select("curve", "part", before.alias("before")), "runs"), ["curve", "part"]).withColumn("at", F.col("pos") + F.col("before"))

    # the window: true neighbours of a bounded sample of queries, by one pass over all rows
    asked_rows = sample(distinct.filter("asked").select("key", "vec"), FIT_QUERIES)
    if not asked_rows:
        return spark.createDataFrame([], schema)
    fit_keys = np.array([r.key for r in asked_rows], np.int64)
    fit_vecs = np.frombuffer(b"".join(bytes(r.vec) for r in asked_rows), "<f8").reshape(-1, width)

    def true_nearest(batches):
        for b in batches:
            if b.num_rows:
                keys = b.column(0).to_numpy()
                rows, cols, dist = _nearest_rows(fit_vecs, _matrix(b.column(1), width), keys, middle, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(fit_keys[rows]), pa.array(keys[cols]), pa.array(dist)], ["q", "key", "d"])

    by_query = Window.partitionBy("q").orderBy("d", "key")
    truth = distinct.select("key", "vec").mapInArrow(true_nearest, "q long, key long, d double").filter("q <> key").withColumn("n", F.row_number().over(by_query)).filter(F.col("n") <= k).collect()
    wanted = sorted({*fit_keys.tolist(), *(r.key for r in truth)})
    at = {(r.curve, r.key): r.at for r in ranked.select("curve", "key", "at").filter(F.col("key").isin(wanted)).collect()}
    gaps = sorted(min(abs(at[c, r.q] - at[c, r.key]) for c in range(curves)) for r in truth)
    window = gaps[min(len(gaps) - 1, math.ceil(target * len(gaps)))] if gaps else n

    place = ["curve", "block"]
    first, last = F.floor(F.greatest(F.col("at") - window, F.lit(0)) / block), F.floor(F.least(F.col("at") + window, F.lit(n - 1)) / block)
    asks = ranked.filter("asked").select(F.col("curve").alias("q_curve"), F.explode(F.sequence(first, last)).alias("q_block"), F.col("key").alias("q"), F.col("vec").alias("q_vec"))
    deals = materialise(asks.groupBy("q_curve", "q_block").agg(F.ceil(F.count("*") / deal).cast("int").alias("q_deals")), "deals")  # a row per block asked
    asks = asks.join(deals, ["q_curve", "q_block"]).select("q_curve", "q_block", F.pmod(F.xxhash64("q"), F.col("q_deals")).cast("int").alias("q_deal"), "q", "q_vec")
    deals = deals.toDF(*place, "deals")
    blocks = ranked.select("curve", F.floor(F.col("at") / block).alias("block"), "key", "vec").join(deals, place).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))

    def search(rows, asking):
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if rows.num_rows and asking.num_rows:
            x, keys = _matrix(rows["vec"], width), rows["key"].to_numpy()
            for i in range(0, asking.num_rows, 256):
                some = asking.slice(i, 256)
                q, near, dist = _nearest_rows(_matrix(some["q_vec"], width), x, keys, middle, k + 1)
                for o, v in zip(out, (some["q"].to_numpy()[q], keys[near], dist)):
                    o.append(v)
        return pa.table({name: np.concatenate(o) for name, o in zip(("q", "key", "score"), out)})

    found = blocks.groupBy(*place, "deal").cogroup(asks.groupBy("q_curve", "q_block", "q_deal")).applyInArrow(search, "q long, key long, score double")
    merged = found.groupBy("q", "key").agg(F.min("score").alias("score"))
    merged = materialise(merged.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "key"))).filter(F.col("n") <= k + 1), "found")
    lists = merged.join(distinct.select("key", "ids"), "key").select("q", "score", F.explode("ids").alias("vec_id"))
    askers = packed.filter(is_query).select(F.col("vec_id").alias("query_id"), "vec").distinct().join(distinct.filter("asked").select("vec", F.col("key").alias("q")), "vec")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    # the few ids that any query of this vector can need, then each query's own list
    top = lists.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).filter(F.col("n") <= k + 1).drop("n")
    ranks = askers.select("query_id", "q").join(top, "q").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranks.select("query_id", "rank", "vec_id", "score")
