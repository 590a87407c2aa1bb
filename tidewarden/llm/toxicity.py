"""Operator 11: toxicity, by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its words, its pairs of neighbouring words, and its pairs of
words with one or two others between them (``GAPS``), each hashed to one of ``SLOTS``
slots and counted once a text however often it occurs (a word as 1, a pair as
``PAIR``), so that a long text is no stronger evidence than a short one that says the
same.  The weights are learned by
follow-the-regularised-leader with a step size per slot and an L1 penalty: a slot keeps
a weight only where its gradients add up past ``L1``, so nearly all are exactly zero
and what is sent to the tasks is a list of the others (``Model.slots``), at most
``MAX_WEIGHTS`` of them by size and in practice a few hundred.

Fitted on a bounded sample (sampling.py; ``PER_CLASS`` rows of each class, held out:
crc32(doc_id as text) mod 4 is 2).  The classes are sampled evenly, so each row's loss
carries the weight that restores the classes' shares among all learnable rows, tempered by a square root; a
score of ``THRESHOLD`` is then the stated border.

Null, empty and wordless texts have no feature and get the score of the bias alone.
Without labels of both classes every score is the share of the class at hand (0 if there
are no labels: nothing is called toxic unlearned).  A score of exactly the threshold
counts as 1.  Repeated rows repeat.  A very long text is read whole, in stretches whose
pairs go on across their borders.  Only text is read when scoring; other columns,
whatever their names, take no part.  An empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forced_bpe import release
from .sampling import held_out, labelled_sample
from .storage import arrow_rows
from .tokens import slices

FOLD = (4, 2)
SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
#: Words from one of a pair to the other: neighbours, then skip-grams.
GAPS = (1, 2, 3)
PER_CLASS = 3000
MAX_CHARS = 20_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.1
#: Value of a pair where a word's is 1.
PAIR = 0.2
#: Weights kept and sent to the tasks: 12 bytes each.
MAX_WEIGHTS = 1 << 18
THRESHOLD = 0.3
#: Characters of a text read at once, and word hashes remembered by a process.
STRETCH, KEEP_WORDS = 1 << 20, 200_000

_WORD = re.compile(r"\w+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    """Word to 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEEP_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed=11)
        return found


_HASHES = WordHashes()


def _stretches(text: str):
    """Parts of a text that no word spans."""
    start = 0
    while start < len(text):
        stop = start + STRETCH
        if stop < len(text) and (gap := re.compile(r"\W").search(text, stop)):
            stop = gap.start()
        elif stop < len(text):
            stop = len(text)
        yield text[start:stop]
        start = stop


def features(text: str | None):
    """(value, slots) of every word and of every pair, a stretch and a kind at a time."""
    before = np.zeros(0, np.uint64)
    for part in _stretches((text or "").lower()):
        words = _WORD.findall(part)
        h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
        yield 1.0, _slots(h)
        known, h = len(before), np.concatenate([before, h])
        for gap in GAPS:
            first = max(0, known - gap)  # pairs wholly in the last stretch were given then
            a, b = h[first:-gap], h[first + gap :]
            yield PAIR, _slots(a * _MIX[gap] ^ (b + (a >> np.uint64(29))))
        before = h[-max(GAPS) :]


def _slots(h: np.ndarray) -> np.ndarray:
    return ((h * _MIX[0]) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def values(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text: slots (of words, then of pairs) and values."""
    found: dict[float, list] = {1.0: [], PAIR: []}
    for value, slots in features(text):
        found[value].append(slots)
    own = {v: np.unique(np.concatenate([*x, np.zeros(0, np.int64)])) for v, x in found.items()}
    return np.concatenate([*own.values()]), np.concatenate([np.full(len(x), v) for v, x in own.items()])


@dataclass
class Model:
    slots: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    prior: float | None = None  # the one answer, where nothing could be learned
    dense: np.ndarray | None = field(default=None, repr=False, compare=False)

    held: np.ndarray | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "dense": None, "held": None}

    def score(self, text: str | None) -> float:
        if self.prior is not None:
            return self.prior
        if self.dense is None:
            self.dense, self.held = np.zeros(SLOTS, np.float32), np.zeros(SLOTS, bool)
            self.dense[self.slots], self.held[self.slots] = self.weights, True
        hits: dict[float, set] = {1.0: set(), PAIR: set()}  # slots with a weight: no more than there are
        for value, slots in features(text):
            hits[value].update(slots[self.held[slots]].tolist())
        logit = self.bias + sum(value * float(self.dense[sorted(own)].sum(dtype=np.float64)) for value, own in hits.items() if own)
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def train(rows: list[tuple[int, str, int]], share: float | None = None, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """``share``: of class 1 among all learnable rows."""
    labels = [int(y) for _, _, y in rows]
    nothing = Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, 0.0)
    if len(set(labels)) < 2:
        nothing.prior = float(labels[0]) if labels else 0.0
        return nothing
    here = sum(labels) / len(labels)
    share = here if share is None else share
    weight = {1: (share / here) ** 0.5, 0: ((1 - share) / (1 - here)) ** 0.5}
    seen = [values(text) for _, text, _ in rows]
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)
    bias, bias_n = float(np.log(weight[1] * here / (weight[0] * (1 - here)))), 1.0

    def weights(slots):
        own = z[slots]
        return np.where(np.abs(own) > L1, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[slots])) / ALPHA + L2), 0.0)

    order, shuffle = list(range(len(rows))), random.Random(seed)
    for _ in range(epochs):
        shuffle.shuffle(order)
        for i in order:
            slots, x = seen[i]
            w = weights(slots)
            error = (1 / (1 + np.exp(-np.clip((w * x).sum() + bias, -30, 30))) - labels[i]) * weight[labels[i]]
            g, own = error * x, n[slots]
            z[slots] += g - (np.sqrt(own + g * g) - np.sqrt(own)) / ALPHA * w
            n[slots] = own + g * g
            bias_n += error * error
            bias -= 0.1 * ALPHA * error / bias_n**0.5
    every = weights(np.arange(SLOTS))
    kept = np.flatnonzero(every)
    kept = np.sort(kept[np.lexsort((kept, -np.abs(every[kept])))][:MAX_WEIGHTS])
    return Model(kept, every[kept].astype(np.float32), float(bias))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    counts = {r[0]: r[1] for r in known.filter(~held_out(FOLD)).groupBy("toxic").count().collect()}
    total = sum(counts.values())
    return train(labelled_sample(docs, known, "toxic", per_class, MAX_CHARS, FOLD), counts.get(1, 0) / total if total else None)


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(fit(docs, labels) if model is None else model)  # MAX_WEIGHTS weights at most

    def run(batches):
        release()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sent.value.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    arrow_rows(spark)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
