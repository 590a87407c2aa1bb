"""Exact Jaccard similarity join over character shingles, and what is built on it.

Candidates come from no LSH.  Inside a table the sets meet by classes of size, and pairs
pass by counts of their shingles in buckets and by parity bits, without loss, before the
sets themselves are compared, in integers: neither shingles nor candidates are shuffled.
The counts are compared as matrices, and groups of rows that lie apart (texts of two
languages) are passed over whole.  The pairs looked at are those of fitting sizes, so the
time has a part that grows with their number, though the disk does not.  Rows of equal
sets are merged before and share one row's edges.

Against a reference, candidates come from prefix filtering: with shingles in any one
order, two sets of Jaccard t or more share one among the first ``n - ceil(t * n) + 1`` of
each.  The order is (sketched count, hash), rarest first: a count-min sketch of fixed
size, summed in Spark, is sent to the tasks, so every row finds its own prefix and no
shingle is shuffled to be counted or ranked.  Size, place and parity tests follow.
Against a reference the sketch is that of the reference: a shingle it counts 0 times is
not there.  A row with too few others leaves the scan at once, without a key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.shared import arrow_rows, materialise

SIZE = 5
THRESHOLD = (4, 5)


def shingles(text: Column, size: int = SIZE) -> Column:
    """Distinct windows of ``size`` characters of the lower-cased text; one at least.

    The windows that do not overlap, from each of ``size`` starts: a few passes of one
    pattern instead of a step for every character.
    """
    whole = F.lit(f"(?s).{{{size}}}")
    windows = lambda t: F.flatten(F.array(*[F.regexp_extract_all(F.substr(t, F.lit(k)), whole, 0) for k in range(1, size + 1)]))
    return let(F.lower(text), lambda t: F.when(F.length(t) < size, F.array(t)).otherwise(F.array_distinct(windows(t))))


#: Rows and columns (as a power of two) of the sketch: 4 MB in all, whatever the input.
SKETCH_ROWS, SKETCH_BITS = 2, 18
#: Set ids that are sent to a scan to pick its rows; beyond, the rows are joined.
MAX_IDS = 1_000_000
#: Windows of a text hashed at once.
STRETCH = 1 << 20
BITS = 32
#: Low bits of a shingle's hash that say the least of its runs of four characters: neighbours in a text often share them.
RUN = 11

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def _hashed(points: np.ndarray, size: int, salt: int) -> np.ndarray:
    h = np.full(len(points) - size + 1, np.uint64(salt))
    if size < 3:
        for k in range(size):
            h = (h ^ points[k : k + len(h)]) * _ODD[0]
            h ^= h >> np.uint64(29)
        h *= _ODD[1]
    else:
        runs = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]  # whole, as a code point has 21 bits at most
        runs *= _ODD[0]
        runs ^= runs >> np.uint64(32)
        runs *= _ODD[1]
        for k in [*range(0, size - 3, 3), size - 3]:
            h ^= runs[k : k + len(h)]
            h *= _ODD[2]
            h ^= h >> np.uint64(29)
        h *= _ODD[0]
        longer = runs[:-1] * _ODD[2] ^ runs[1:] if size > 3 else runs
        least = np.minimum.reduce([longer[k : k + len(h)] for k in range(max(1, size - 3))]) * _ODD[1]
        h >>= np.uint64(RUN)
        h <<= np.uint64(RUN)
        h |= least >> np.uint64(64 - RUN)
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def gram_hashes(text: str | None, group: str | None = None, size: int = SIZE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct windows of the lower-cased text, as shingles().

    With a group, the group is part of every hash, so sets of two groups share nothing.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    salt = size if group is None else xxhash.xxh64_intdigest(group.encode("utf-8", "surrogatepass"), seed=size)
    if len(points) < size:
        return _hashed(np.append(points, np.uint32((1 << 21) - 1)).astype(np.uint64), len(points) + 1, salt)
    found = np.zeros(0, np.uint64)
    for at in range(0, len(points) - size + 1, STRETCH):
        own = _hashed(points[at : at + STRETCH + size - 1].astype(np.uint64), size, salt)
        found = np.union1d(found, own) if len(found) else own
    return found


@dataclass
class Sketch:
    """Count-min sketch: counts that are never too small, in a table of fixed size."""

    counts: np.ndarray  # row x column

    @staticmethod
    def columns(grams: np.ndarray) -> list[np.ndarray]:
        return [((grams * _ODD[1 + r]) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64) for r in range(SKETCH_ROWS)]

    def estimate(self, grams: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([self.counts[r][c] for r, c in enumerate(self.columns(grams))])


def _rows(df: DataFrame, key: Column, text: str, within: str | None, deal: bool = True) -> DataFrame:
    arrow_rows(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if deal and 0 < len(df.inputFiles()) < cores:  # fewer files than cores: texts are dealt out before they are hashed
        df = df.repartition(cores)
    return df.select(key.alias("id"), F.col(text).cast("string").alias("text"), (F.lit(None) if within is None else F.coalesce(F.col(within).cast("string"), F.lit(""))).cast("string").alias("within"))


def _each(batch: pa.RecordBatch):
    return zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())


def sketch(df: DataFrame, text: str = "text", within: str | None = None) -> Sketch:
    """Of the shingles of all rows: a task hands on no more counts than the sketch has cells."""

    def run(batches):
        counts = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64)
        for batch in batches:
            for t, g in _each(batch):
                for r, c in enumerate(Sketch.columns(gram_hashes(t, g))):
                    counts[r] += np.bincount(c, minlength=1 << SKETCH_BITS)
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts.ravel()[cells])], ["cell", "n"])

    cells = _rows(df, F.lit(0), text, within).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # the sketch's cells at most
    counts = np.zeros(SKETCH_ROWS << SKETCH_BITS, np.int64)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return Sketch(counts.reshape(SKETCH_ROWS, -1))


def parity_bits(grams: np.ndarray) -> np.ndarray:
    """32 words of parity bits of a set: differing bits are at most the symmetric difference."""
    odd = np.bincount((grams >> np.uint64(RUN) & np.uint64(64 * BITS - 1)).astype(np.int64), minlength=64 * BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


_SET = "set_id long, n int, keys array<struct<key: bigint, place: int>>, bits array<bigint>"


def _described(df: DataFrame, key: Column, text: str, within: str | None, order: Sketch, threshold, least: int, near: bool) -> DataFrame:
    """id, set_id, n, keys (the prefix in the sketch's order, with places; those counted under ``least`` times are left out), parity bits.

    ``near``: only rows of which enough shingles are in the sketch for the threshold.
    """
    num, den = threshold
    rows = _rows(df, key, text, within)
    sent = df.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        sketched = sent.value
        for batch in batches:
            at, ids, sizes, keys, places, ends, bits = [], [], [], [], [], [0], []
            for i, (t, g) in enumerate(_each(batch)):
                grams = gram_hashes(t, g)
                n, counts = len(grams), sketched.estimate(grams)
                if near and int((counts > 0).sum()) * den < n * num:
                    continue
                first = np.lexsort((grams, counts))[: n - -(-n * num // den) + 1]
                own = np.flatnonzero(counts[first] >= least)
                at.append(i)
                ids.append(xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63))
                sizes.append(n)
                keys.append(grams[first[own]].view(np.int64))
                places.append(own)
                ends.append(ends[-1] + len(own))
                bits.append(parity_bits(grams))
            join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
            pairs = pa.StructArray.from_arrays([pa.array(join(keys)), pa.array(join(places).astype(np.int32))], ["key", "place"])
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * BITS), pa.array(join(bits)))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), words]
            yield pa.RecordBatch.from_arrays(columns, ["id", "set_id", "n", "keys", "bits"])

    return materialise(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {_SET}"), "sets")


def _grams(df: DataFrame, text: str, within: str | None, needed: DataFrame) -> DataFrame:
    """set_id, grams of the sets whose ids are ``needed``: hashed again from the texts, so only these are ever written."""
    spark = df.sparkSession
    few = needed.count() <= MAX_IDS
    sent = spark.sparkContext.broadcast(np.sort(needed.toArrow()["set_id"].to_numpy()) if few else None)

    def run(batches):
        wanted = sent.value
        for batch in batches:
            ids, sets = [], []
            for t, g in _each(batch):
                grams = gram_hashes(t, g)
                set_id = xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63)
                place = 0 if wanted is None else np.searchsorted(wanted, set_id)
                if wanted is None or place < len(wanted) and wanted[place] == set_id:
                    ids.append(set_id)
                    sets.append(grams.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["set_id", "grams"])

    found = _rows(df, F.lit(0), text, within).mapInArrow(run, "set_id long, grams array<long>")
    return materialise((found if few else found.join(needed, "set_id", "left_semi")).dropDuplicates(["set_id"]), "grams")


def _near(a: DataFrame, b: DataFrame, threshold, ordered: bool) -> DataFrame:
    """(a, b): pairs of sets that share a key and may reach the threshold by sizes, places and parity bits; ``ordered``: a < b only.

    Jaccard >= num/den asks for an overlap of (|a| + |b|) num / (num + den).  Of the first
    shared key, both sets hold the overlap's other members behind it.  It also bounds
    the symmetric difference by (|a| + |b|)(den - num)/(den + num), and the differing
    parity bits are no more than it.
    """
    num, den = threshold
    keyed = lambda s, side: s.select(F.col("set_id").alias(side), F.col("n").alias(f"n{side}"), F.explode("keys").alias("k")).select(side, f"n{side}", F.col("k.key").alias(f"k{side}"), F.col("k.place").alias(f"p{side}"))
    na, nb = F.col("na"), F.col("nb")
    fits = (na * den >= nb * num) & (nb * den >= na * num) & (F.least(na - F.col("pa"), nb - F.col("pb")) * (num + den) >= (na + nb) * num)
    found = keyed(a, "a").join(keyed(b, "b"), (F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b") if ordered else F.lit(True)) & fits).select("a", "na", "b", "nb").distinct()
    bits = lambda s, side: s.select(F.col("set_id").alias(side), F.col("bits").alias(f"w{side}"))
    apart = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return materialise(found.join(bits(a, "a"), "a").join(bits(b, "b"), "b").filter(apart * (den + num) <= (na + nb) * (den - num)).select("a", "b"), "near")


def _verified(near: DataFrame, left: DataFrame, right: DataFrame, threshold) -> DataFrame:
    num, den = threshold
    both = F.size(F.array_intersect("ga", "gb"))
    grams = lambda side, s: s.select(F.col("set_id").alias(side), F.col("grams").alias(f"g{side}"))
    return near.join(grams("a", left), "a").join(grams("b", right), "b").filter(both * den >= (F.size("ga") + F.size("gb") - both) * num).select("a", "b")


def _ids(*columns: DataFrame) -> DataFrame:
    out = columns[0].toDF("set_id")
    for c in columns[1:]:
        out = out.unionByName(c.toDF("set_id"))
    return materialise(out.distinct(), "needed")


#: Blocks that each class of sizes is dealt into; every pair of them is a cell, so a row is handed on that many times.
BLOCKS = 6
#: Pairs of similar sets that are compared in one cell, about.
CELL_PAIRS = 20_000
#: Characters of text that a cell has hashed at once, about half.
CELL_CHARS = 1 << 22
#: Rows compared with so many others at once, and bytes of parity bits compared at once.
TILE, OTHERS, CACHE = 256, 2048, 1 << 18
#: A bucket's count stops here: it is no more apart than the shingles are.
MOST = 15


def _bounds(most: int, threshold) -> np.ndarray:
    """Least sizes of the classes, in whole numbers: sets of fitting sizes are of one class or of neighbours."""
    num, den = threshold
    out = [0, 1]
    while out[-1] <= most:
        out.append(out[-1] * den // num + 1)
    return np.array(out)


def _words(above: int, threshold) -> int:
    """64-bit words of parity for sets of fewer than ``above`` shingles: unrelated ones differ in about half of the bits, which is more than similar ones can."""
    num, den = threshold
    bits = 2.15 * above * (den - num) / num
    return int(bits + 5 * bits**0.5 + 32) // 64 + 1


def _parity(grams: np.ndarray, words: int) -> bytes:
    odd = np.bincount(((grams >> np.uint64(32)) * np.uint64(64 * words) >> np.uint64(32)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _buckets(above: int) -> int:
    """Buckets for sets of fewer than ``above`` shingles."""
    return min(max(above // 160 * 32, 64), 1 << RUN)


def _counts(grams: np.ndarray, buckets: int) -> bytes:
    """Shingles in each bucket, MOST at most, two buckets a byte.

    A bucket takes runs of text, not single shingles, so that the counts of unrelated texts
    lie further apart than chance would deal them.
    """
    bucket = ((grams & np.uint64((1 << RUN) - 1)) * np.uint64(buckets)) >> np.uint64(RUN)
    n = np.minimum(np.bincount(bucket.astype(np.int64), minlength=buckets), MOST).astype(np.uint8)
    return (n[0::2] | n[1::2] << 4).tobytes()


_SIGNED = "set_id long, text_id long, n int, class int, own binary, below binary, own_counts binary, below_counts binary"


def _signed(df: DataFrame, key: Column, text: str, within: str | None, threshold) -> DataFrame:
    """id, set_id, text_id, n, class, parity bits and counts as long as the class and as the class below ask for."""
    rows = _rows(df, key, text, within).select("*", F.xxhash64("text", "within").alias("text_id"))

    def run(batches):
        bounds = _bounds(1, threshold)
        for batch in batches:
            out = []
            for t, g in _each(batch):
                grams = gram_hashes(t, g)
                n = len(grams)
                bounds = bounds if n < bounds[-1] else _bounds(n, threshold)
                c = int(np.searchsorted(bounds, n, "right"))  # bounds[c - 1] <= n < bounds[c]
                signs = [f(grams, g(int(above))) for f, g in ((_parity, lambda x: _words(x, threshold)), (_counts, _buckets)) for above in (bounds[c], bounds[c - 1])]
                out.append((xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63), n, c, *signs))
            ids, sizes, classes, *signs = zip(*out) if out else ((),) * 7
            columns = [batch.column(0), pa.array(ids, pa.int64()), batch.column(3), pa.array(sizes, pa.int32()), pa.array(classes, pa.int32()), *[pa.array(x, pa.binary()) for x in signs]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "set_id", "text_id", "n", "class", "own", "below", "own_counts", "below_counts"])

    return materialise(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {_SIGNED}"), "sets")


def _middles(shares: np.ndarray) -> np.ndarray:
    """Middles of up to eight groups of rows (k-means on some of the rows); any choice of them is right, a good one is quick."""
    some = shares[:: -(-len(shares) // 2000)]
    middles = some[:: -(-len(some) // min(8, 1 + len(shares) // TILE))]
    for _ in range(5):
        own = _nearest(some, middles)
        middles = np.stack([some[own == k].mean(axis=0) if (own == k).any() else m for k, m in enumerate(middles)])
    return middles


def _nearest(shares: np.ndarray, middles: np.ndarray) -> np.ndarray:
    return (shares @ middles.T - (middles * middles).sum(axis=1) / 2).argmax(axis=1)


class _Cell:
    """Rows of one cell, and the pairs of them that may reach the threshold.

    Jaccard >= num/den bounds the symmetric difference by (|a| + |b|)(den - num)/(den + num).
    The differing parity bits are no more than it, nor is the difference of any sum of
    the buckets' counts with weights of 1 and -1.  Where those weights are the signs of a
    row's own deviations, the sums of many pairs are one product of matrices, in whole
    numbers; where they tell two groups of rows apart, one sum of every row is enough.
    """

    def __init__(self, n: np.ndarray, bits: np.ndarray, counts: np.ndarray, threshold):
        self.n, self.bits, self.counts, (num, den) = n, bits, counts, threshold
        self.num, self.den, self.sum, self.gap = num, den, den + num, den - num
        self.kind = np.float32 if int(n.max(initial=0)) * self.sum < 1 << 24 else np.float64  # exact for whole numbers
        self.rank = np.zeros(len(n), np.int64)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def meet(self, left: np.ndarray, right: np.ndarray, same: bool) -> None:
        """Rows ``left`` with rows ``right``; ``same``: each pair of one set of rows."""
        if not len(left) or not len(right):
            return
        left, right = (rows[np.argsort(self.n[rows], kind="stable")] for rows in (left, right))
        self.rank[right] = np.arange(len(right))
        shares = lambda rows: self.counts[rows] / self.n[rows, None].astype(np.float32)
        middles = _middles(shares(left))
        of, by = (np.concatenate([_nearest(shares(rows[k : k + OTHERS]), middles) for k in range(0, len(rows), OTHERS)]) for rows in (left, right))
        for p, middle in enumerate(middles):
            own, odd, others = left[of == p], np.zeros(int((of == p).sum()), bool), by == p
            weights = np.where(middle > middles, self.sum, -self.sum).T.astype(self.kind)
            us, vs = self.sums(own, weights, -self.gap), self.sums(right, weights, self.gap)
            for q in range(len(middles) if len(own) else 0):
                if q != p and (by == q).any():
                    u, v = us[:, q], vs[by == q, q]  # a pair needs u <= v, so u < x or v >= x whatever x
                    x = min(np.quantile(u, [0, 0.003, 0.01, 0.03, 0.1], method="lower"), key=lambda x: int((u < x).sum()) * len(right) + int((u >= x).sum()) * int((v >= x).sum()))
                    odd |= u < x
                    others[by == q] = v >= x
            self.compare(own[odd], right, middle, same)
            self.compare(own[~odd], right[others], middle, same)

    def sums(self, rows: np.ndarray, weights: np.ndarray, gap: int) -> np.ndarray:
        parts = [self.counts[own].astype(self.kind) @ weights + (gap * self.n[own, None]).astype(self.kind) for own in np.split(rows, range(OTHERS, len(rows), OTHERS))]
        return np.concatenate(parts)

    def compare(self, left: np.ndarray, right: np.ndarray, middle: np.ndarray, same: bool) -> None:
        """As meet(), for rows in order of their sizes."""
        if not len(left) or not len(right):
            return
        n, other = self.n[left], self.n[right]
        least, most = np.searchsorted(other * self.den, n * self.num, "left"), np.searchsorted(other * self.num, n * self.den, "right")
        if same:  # with the rows that come later
            least = np.maximum(least, np.searchsorted(self.rank[right], self.rank[left], "right"))
        sums = np.concatenate([self.counts[right], self.gap * other[:, None]], axis=1, dtype=self.kind)
        products, passed = np.empty(TILE * OTHERS, self.kind), np.empty(TILE * OTHERS, bool)
        for at in range(0, len(left), TILE):
            x, size = self.counts[left[at : at + TILE]].astype(np.int64), n[at : at + TILE, None]
            y = np.where(x >= size * middle, self.sum, -self.sum)
            ask = ((x * y).sum(axis=1, keepdims=True) - self.gap * size).astype(self.kind)
            y = np.append(y, np.ones_like(size), axis=1).astype(self.kind)
            last = int(most[at + len(x) - 1])
            for start in range(int(least[at]), last, OTHERS):
                stop = min(start + OTHERS, last)
                shape = (len(x), stop - start)
                product = np.matmul(y, sums[start:stop].T, out=products[: shape[0] * shape[1]].reshape(shape))
                i, j = np.divmod(np.flatnonzero(np.greater_equal(product, ask, out=passed[: product.size].reshape(shape))), stop - start)
                i, j = i + at, j + start
                fit = (j >= least[i]) & (j < most[i])
                self.pairs(left[i[fit]], right[j[fit]])

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        step = max(64, CACHE // (8 * self.bits.shape[1]))
        for at in range(0, len(a), step):
            i, j = a[at : at + step], b[at : at + step]
            words = self.bits[i]
            words ^= self.bits[j]
            near = np.bitwise_count(words).sum(axis=1, dtype=np.uint32) * np.int64(self.sum) <= (self.n[i] + self.n[j]) * self.gap
            if near.any():
                self.found.append((i[near], j[near]))


def _close(sets: DataFrame, threshold) -> DataFrame:
    """(a, b), a < b: all pairs of distinct sets that may reach the threshold by their sizes, counts and parity bits.

    A class meets itself and the class above, whose rows come as guests.  Both are dealt
    into blocks and every pair of blocks is a task's work, so a row is handed on BLOCKS
    times for each of the two, whatever the input; no pair is, but for those that pass.
    """
    sides = [F.struct((F.col("class") - guest).alias("class"), F.lit(bool(guest)).alias("guest"), F.col(of).alias("bits"), F.col(f"{of}_counts").alias("counts")) for guest, of in enumerate(("own", "below"))]
    rows = sets.select("set_id", "n", F.explode(F.array(*sides)).alias("r"))
    block = F.pmod(F.xxhash64("set_id", F.lit("block")), F.lit(BLOCKS)).cast("int")
    dealt = rows.select("set_id", "n", "r.*", block.alias("block")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    dealt = dealt.select("set_id", "n", "class", "guest", "bits", "counts", (F.col("block") > F.col("other")).alias("second"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def cell(table: pa.Table) -> pa.Table:
        ids, guest, second = (table[c].to_numpy() for c in ("set_id", "guest", "second"))
        of = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind).reshape(len(ids), -1)
        packed = of("counts", np.uint8)
        rows = _Cell(table["n"].to_numpy().astype(np.int64), of("bits", np.uint64), np.stack([packed & 15, packed >> 4], axis=2).reshape(len(ids), -1), threshold)
        if table["i"][0] == table["j"][0]:
            hosts = np.flatnonzero(~guest)
            rows.meet(hosts, hosts, True)
            rows.meet(hosts, np.flatnonzero(guest), False)
        else:
            rows.meet(np.flatnonzero(~guest & ~second), np.flatnonzero(second), False)
            rows.meet(np.flatnonzero(guest & ~second), np.flatnonzero(~guest & second), False)
        a, b = (ids[np.concatenate([np.zeros(0, np.int64), *x])] for x in (zip(*rows.found) if rows.found else ((), ())))
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return materialise(dealt.groupBy("class", "i", "j").applyInArrow(cell, "a long, b long"), "near")


def _reached(texts: list, withins: list, a: np.ndarray, b: np.ndarray, threshold) -> np.ndarray:
    """Which of the pairs (places of texts) reach the threshold.

    Shingles of the texts at hand are numbered once, those of a set marked once for all its
    pairs, so a pair takes a look at each shingle of its other set.  Of long texts no more
    than about twice CELL_CHARS are at hand at once, and they are hashed again for others.
    """
    num, den = threshold
    part = np.cumsum([len(t or "") for t in texts]) // CELL_CHARS
    both, keep = part[a] * (part[-1] + 1) + part[b], np.zeros(len(a), bool)
    for k in np.unique(both):
        pairs = np.flatnonzero(both == k)
        used, own = np.unique(np.stack([a[pairs], b[pairs]]), return_inverse=True)
        grams = [gram_hashes(texts[i], withins[i]) for i in used]
        ends = np.cumsum([0, *map(len, grams)])
        known, places = np.unique(np.concatenate(grams), return_inverse=True)
        marked, (x, y) = np.zeros(len(known), bool), own.reshape(2, -1)
        by = np.argsort(x, kind="stable")
        for of in np.split(by, np.flatnonzero(np.diff(x[by])) + 1):
            first = places[ends[x[of[0]]] : ends[x[of[0]] + 1]]
            marked[first] = True
            for p in of:
                other = places[ends[y[p]] : ends[y[p] + 1]]
                shared = int(np.count_nonzero(marked[other]))
                keep[pairs[p]] = shared * den >= (len(first) + len(other) - shared) * num
            marked[first] = False
    return keep


def _compared(near: DataFrame, sets: DataFrame, df: DataFrame, text: str, within: str | None, threshold) -> DataFrame:
    """Of the pairs those that reach the threshold: their texts, which are smaller than their shingles, are brought together and hashed again.

    Pairs come in cells of those whose later set has the same least neighbour, large ones
    dealt by both sets into about CELL_PAIRS each: a text is sent and hashed once a cell,
    not once a pair.
    """
    needed = materialise(near.select("a").union(near.select("b")).toDF("set_id").distinct().join(sets.select("set_id", "text_id"), "set_id"), "needed")
    few = needed.count() <= MAX_IDS
    texts = _rows(df, F.lit(0), text, within, False).select(F.xxhash64("text", "within").alias("text_id"), "text", "within")
    texts = texts.join(F.broadcast(needed) if few else needed, "text_id").dropDuplicates(["set_id"]).select("set_id", "text", "within")
    least = near.groupBy("b").agg(F.min("a").alias("label"), F.count("*").alias("n"))
    sides = least.groupBy("label").agg(F.ceil(F.sqrt(F.sum("n") / CELL_PAIRS)).cast("int").alias("sides"))
    part = lambda c: F.pmod(F.xxhash64(c, F.lit("cell")), F.col("sides"))
    cells = materialise(near.join(least.join(sides, "label").select("b", "label", "sides"), "b").select("a", "b", "label", part("a").alias("i"), part("b").alias("j")), "cells")
    members = cells.select(F.col("label").alias("of"), F.col("i").alias("oi"), F.col("j").alias("oj"), F.explode(F.array("a", "b")).alias("set_id")).distinct().join(texts, "set_id")

    def cell(pairs: pa.Table, own: pa.Table) -> pa.Table:
        of = own["set_id"].to_numpy()
        order = np.argsort(of)
        a, b = (order[np.searchsorted(of, pairs[c].to_numpy(), sorter=order)] for c in ("a", "b"))
        return pairs.select(["a", "b"]).filter(pa.array(_reached(own["text"].to_pylist(), own["within"].to_pylist(), a, b, threshold)))

    return materialise(cells.groupBy("label", "i", "j").cogroup(members.groupBy("of", "oi", "oj")).applyInArrow(cell, "a long, b long"), "similar")


def similar_sets(df: DataFrame, key: str = "id", text: str = "text", threshold=THRESHOLD, within: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(id -> set_id, pairs (a, b), a < b, of similar sets): copies stay one set, no pair is lost."""
    rows = _signed(df, F.col(key), text, within, threshold)
    sets = materialise(rows.drop("id").dropDuplicates(["set_id"]), "distinct-sets")
    return rows.select("id", "set_id"), _compared(_close(sets, threshold), sets, df, text, within, threshold)


def without_similar(df: DataFrame, reference: DataFrame, key: str = "id", text: str = "text", ref_text: str = "text", threshold=THRESHOLD) -> DataFrame:
    """Rows of ``df`` similar to no row of ``reference`` (leakage anti-join).

    Only rows of which the threshold's share of shingles is in the reference's sketch have keys at all.
    """
    order = sketch(reference, ref_text)
    ours = _described(df, F.col(key), text, None, order, threshold, 1, True)
    theirs = _described(reference, F.lit(0), ref_text, None, order, threshold, 1, False)
    distinct = lambda rows: rows.select("set_id", "n", "keys", "bits").dropDuplicates(["set_id"])
    near = _near(distinct(ours), distinct(theirs), threshold, False)
    left, right = _grams(df, text, None, _ids(near.select("a"))), _grams(reference, ref_text, None, _ids(near.select("b")))
    hit = _verified(near, left, right, threshold).select(F.col("a").alias("set_id")).distinct()
    gone = ours.join(hit, "set_id", "left_semi").select(F.col("id").alias(key)).distinct()
    return df.join(gone, key, "left_anti")


def first_kept(df: DataFrame, key: str = "id", text: str = "text", threshold=THRESHOLD, within: str | None = None) -> DataFrame:
    """Greedy de-duplication in id (string) order: a row goes if similar to a row already kept (of its own group, with ``within``).

    The sequential rule is a fixpoint: a row without earlier undecided or kept
    neighbours is kept, its later neighbours go, and so on, until no arc is left; every
    round settles the first undecided row at least.  Each round is a written table.  Copies (equal sets) of a row are its neighbours: only their first can stay.
    """
    ids, edges = similar_sets(df, key, text, threshold, within)
    nodes = ids.groupBy("set_id").agg(F.min(F.col("id").cast("string")).alias("name"))
    name = lambda side: nodes.select(F.col("set_id").alias(side), F.col("name").alias(f"n{side}"))
    named = edges.join(name("a"), "a").join(name("b"), "b")
    early = F.col("na") < F.col("nb")
    arcs = materialise(named.select(F.when(early, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(early, F.col("b")).otherwise(F.col("a")).alias("later")), "arcs")
    kept, live = nodes.select("set_id", "name").join(arcs.select(F.col("later").alias("set_id")).distinct(), "set_id", "left_anti"), arcs
    rounds = [materialise(kept, "kept")]
    while not live.isEmpty():
        gone = live.join(rounds[-1].select(F.col("set_id").alias("first")), "first", "left_semi").select(F.col("later").alias("node")).distinct()
        gone = materialise(gone, "gone")
        rest = live.join(gone.withColumnRenamed("node", "later"), "later", "left_anti").join(gone.withColumnRenamed("node", "first"), "first", "left_anti")
        rest = rest.join(rounds[-1].select(F.col("set_id").alias("first")), "first", "left_anti")
        rest = materialise(rest, "arcs")
        settled = live.select(F.col("later").alias("set_id")).distinct().join(gone.withColumnRenamed("node", "set_id"), "set_id", "left_anti").join(rest.select(F.col("later").alias("set_id")).distinct(), "set_id", "left_anti")
        rounds.append(materialise(nodes.join(settled, "set_id", "left_semi").select("set_id", "name"), "kept"))
        live = rest
    names = rounds[0]
    for r in rounds[1:]:
        names = names.unionByName(r)
    return df.join(names.select(F.col("name").alias("_kept")), F.col(key).cast("string") == F.col("_kept"), "left_semi")
