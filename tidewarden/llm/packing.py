"""Operator 5: best-fit packing by hierarchical residual packing.

1. Every partition tokenises its documents, cuts only those longer than a
   sequence, and packs the pieces best-fit (longest first) into bins.
2. Bins filled to within ``slack`` ids of the capacity (0: full ones) are done.  The others
   are items of the next round, in which ``fan_in`` neighbouring groups merge, and so
   on up the tree, until one group is left.  Rounds move bins' numbers and fills
   only; pieces stay where the first step wrote them.
3. No bin is closed early that a later round could use.  After best fit at most one
   bin of a group is half full or less, and two fuller ones never go together, so
   the rounds to come cannot touch more of the fuller bins than there are others
   left in all groups.  Two rules follow, both without loss: a bin is done if the
   least filled one of all groups does not fit into it; and of a group's bins of
   one fill, as many as there are bins of half fill or less anywhere are enough.
   A group hands on at most that many for each fill, of 16 bytes each.

Each round's moves are a written table in the shared folder, so a lost executor
repeats one round's tasks at most.  The last step follows the moves of the open bins
and joins them to their pieces; bins done in the first step are not shuffled.

Null or empty texts are a piece of one id (the end id); repeated rows are packed as
often as they occur; a null doc_id is kept; a very long text is cut into pieces of a
whole sequence, the last one shorter; among items of one size the earlier goes first.
Other columns, whatever their names, take no part.  An empty table gives no sequences.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forced_bpe import DEFAULT_VOCABULARY, encoder
from .storage import arrow_rows, materialise
from .tokens import slices

CAPACITY = 2048
END_ID = 0
SLACK = 0
FAN_IN = 8

_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
_BIN = "bin long, home long, fill int, open boolean, pieces array<struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint, offset: bigint>>"
_MOVE = "child long, parent long, shift int, home long, fill int, leads boolean"


def best_fit(sizes, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indexes of the items of each bin.

    A bit set of the residuals at hand finds the tightest bin that still fits in
    one step; ties between items go to the earlier one.
    """
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for i in np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = by_room[room]
            b = own.pop()
            if not own:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins


def useful(fills: np.ndarray, capacity: int, least: int, small: int) -> np.ndarray:
    """Bins that a later round may use, given the least fill of all groups and how many bins are half full or less."""
    fills = np.asarray(fills, np.int64)
    order = np.argsort(fills, kind="stable")
    own = fills[order]
    nth = np.arange(len(own)) - np.searchsorted(own, own)  # place among the bins of this fill
    keep = np.zeros(len(fills), bool)
    keep[order] = (2 * own <= capacity) | ((nth < small) & (own + least <= capacity))
    return keep


def _bins(rows: list[tuple], capacity: int, slack: int):
    """Record batches of a partition's packed pieces (doc_id, piece, start, length, crc, null)."""
    doc, piece, start, length, crc = (np.array(c, np.int64) for c in rows[:5])
    null = np.array(rows[5], bool)
    part = TaskContext.get().partitionId()
    chosen = best_fit(length, capacity)
    for at in range(0, len(chosen), 2000):
        own = chosen[at : at + 2000]
        flat = np.concatenate([np.array(b) for b in own])
        sizes = np.array([len(b) for b in own])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        sums = np.concatenate([[0], np.cumsum(length[flat])])
        fills = sums[ends[1:]] - sums[ends[:-1]]
        offset = sums[:-1] - np.repeat(sums[ends[:-1]], sizes)
        values = [pa.array(c[flat], t) for c, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()))]
        pieces = pa.StructArray.from_arrays([pa.array(doc[flat], pa.int64(), mask=null[flat]), *values, pa.array(offset, pa.int64())], fields=list(_PIECE))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((part << 32) + np.arange(at, at + len(own))), pa.array(np.full(len(own), part, np.int64)), pa.array(fills, pa.int32()),
                pa.array(fills < capacity - slack), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces),
            ],
            ["bin", "home", "fill", "open", "pieces"],
        )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = DEFAULT_VOCABULARY, slack: int = SLACK, fan_in: int = FAN_IN, end_id: int = END_ID) -> DataFrame:
    """One row per placed piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""

    def first(batches):
        enc = encoder(vocabulary)
        end = np.array([end_id], "<u4")
        cols: list[list] = [[], [], [], [], [], []]
        for batch in slices(batches):
            names = batch.column(0).to_pylist()
            for name, raw in zip(names, enc.encode_batch(batch.column(1).to_pylist())):
                ids = np.concatenate([np.frombuffer(raw, enc.dtype).astype("<u4"), end])
                for k, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    for c, v in zip(cols, (name or 0, k, start, len(own), zlib.crc32(own.tobytes()), name is None)):
                        c.append(v)
        if cols[0]:
            yield from _bins(cols, capacity, slack)

    arrow_rows(docs.sparkSession)
    bins = materialise(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(first, _BIN), "bins")
    rounds = _merge_rounds(bins.filter("open").select("bin", "home", "fill"), capacity, slack, fan_in)
    pieces = ["p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", (F.col("p.offset") + F.col("shift")).alias("offset")]
    unmoved = bins.filter("not open").select(F.col("bin").alias("sequence_id"), F.lit(0).alias("shift"), "pieces")
    moved = bins.filter("open").join(_followed(rounds), F.col("bin") == F.col("child"), "left") if rounds else bins.filter("open").withColumns({"parent": F.col("bin"), "shift": F.lit(0)})
    moved = moved.select(F.coalesce("parent", "bin").alias("sequence_id"), F.coalesce("shift", F.lit(0)).alias("shift"), "pieces")
    return unmoved.unionByName(moved).select("sequence_id", "shift", F.explode("pieces").alias("p")).select(*pieces)


def _merge(level: int, capacity: int, least: int, small: int):
    """One round's work on one group: (group number, its open bins) to moves."""

    def run(key, group):
        home, fills, names = key[0].as_py(), group["fill"].to_numpy().astype(np.int64), group["bin"].to_numpy()
        on = np.flatnonzero(useful(fills, capacity, least, small))
        on = on[np.lexsort((names[on], fills[on]))]  # rows of a group come in any order
        chosen = best_fit(fills[on], capacity)
        flat = on[np.concatenate([np.array(b, np.int64) for b in [*chosen, []]])]
        sizes = np.array([len(b) for b in chosen], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        sums = np.concatenate([[0], np.cumsum(fills[flat])])
        shift = sums[:-1] - np.repeat(sums[ends[:-1]], sizes)
        each = np.repeat(np.arange(len(chosen)), sizes)
        fill = (sums[ends[1:]] - sums[ends[:-1]])[each]
        parent = (level << 56) + (home << 32) + each
        return pa.table({"child": names[flat], "parent": parent, "shift": shift.astype(np.int32), "home": np.full(len(flat), home), "fill": fill.astype(np.int32), "leads": shift == 0})

    return run


def _merge_rounds(items: DataFrame, capacity: int, slack: int, fan_in: int) -> list[DataFrame]:
    """Moves of every round: child bin, parent bin, the child's place there, and the parent's home and fill."""
    rounds: list[DataFrame] = []
    while True:
        last, least, small, n = items.agg(F.max("home"), F.min("fill"), F.count_if(2 * F.col("fill") <= capacity), F.count("*")).first()
        if n < 2 or last == 0:
            return rounds
        level = len(rounds) + 1
        grouped = items.groupBy(F.floor(F.col("home") / fan_in).alias("group"))
        rounds.append(materialise(grouped.applyInArrow(_merge(level, capacity, least, small), _MOVE), f"moves{level}"))
        items = rounds[-1].filter(F.col("leads") & (F.col("fill") < capacity - slack)).select(F.col("parent").alias("bin"), "home", "fill")


def _followed(rounds: list[DataFrame]) -> DataFrame:
    """child, parent, shift of every bin open after the first step: its last bin and its place there."""
    at = rounds[0].select("child", "parent", "shift")
    for moves in rounds[1:]:
        on = moves.select(F.col("child").alias("was"), F.col("parent").alias("now"), F.col("shift").alias("more"))
        at = at.join(on, F.col("parent") == F.col("was"), "left").select("child", F.coalesce("now", "parent").alias("parent"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
    return at
