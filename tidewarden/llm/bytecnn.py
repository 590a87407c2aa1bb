"""Operator 10: quality classifier, a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it.  In
each chunk ``FILTERS`` learned filters of ``WIDTH`` bytes are evaluated at every
``STRIDE``-th byte (so neighbouring places overlap) and max-pooled; the chunks' mean
and maximum go through one logistic unit to a probability.  A filter of byte
embeddings is a table of one value per (place, byte, filter), so evaluating it is a
sum of table rows.

Trained by Adagrad on the log loss of a bounded sample of labelled rows
(sampling.py; ``PER_CLASS`` rows a class).  The classes are sampled evenly, so each
row's loss carries the weight that restores the classes' shares among all learnable
rows, tempered by a square root; a score of 0.3 is then the stated threshold.  Short
passages of good rows are trained on as good, so that brevity alone costs nothing.

Null and empty texts are one chunk of padding and get that chunk's score.  Without
labels of both classes every score is the share of the class at hand (0.5 if none).
A score of exactly the threshold counts as 1.  Repeated rows repeat.  A very long text
is scored over all its chunks, a few at a time.  Only text is read when scoring; other
columns, whatever their names, take no part.  An empty table gives no rows.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forced_bpe import release
from .sampling import held_out, labelled_sample
from .storage import arrow_rows, map_rows
from .tokens import slices

CHUNK, OVERLAP = 1024, 64
WIDTH, STRIDE, FILTERS = 6, 2, 16
PER_CLASS = 1200
MAX_CHARS = 20_000
EPOCHS = 5
RATE = 0.08
THRESHOLD = 0.3
#: Chunks evaluated at once.
GROUP = 32


def chunks_of(text: str | None) -> np.ndarray:
    """Overlapping rows of CHUNK bytes (plus a filter's width) that cover the text; padded by zeros."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-max(len(data) - OVERLAP, 1) // step))
    size = CHUNK + WIDTH - STRIDE
    if n == 1:  # short texts: no more places than bytes
        size = min(size, -(-(max(len(data), 1) + WIDTH) // STRIDE) * STRIDE)
    padded = np.zeros(step * (n - 1) + size, np.uint8)
    padded[: len(data)] = data[: len(padded)]
    return np.lib.stride_tricks.as_strided(padded, (n, size), (step, 1))


@dataclass
class Network:
    table: np.ndarray  # place in filter x byte x filter
    bias: np.ndarray
    out: np.ndarray  # mean part, maximum part
    out_bias: float
    prior: float | None = None  # the one answer, where nothing could be learned

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per chunk and filter: the maximum and its place."""
        places = (chunks.shape[1] - WIDTH) // STRIDE + 1
        stop = (places - 1) * STRIDE + 1
        sums = self.table[0][chunks[:, 0:stop:STRIDE]]
        for k in range(1, WIDTH):
            sums += self.table[k][chunks[:, k : k + stop : STRIDE]]
        at = sums.argmax(1)
        return np.take_along_axis(sums, at[:, None, :], 1)[:, 0, :], at

    def score(self, text: str | None) -> float:
        if self.prior is not None:
            return self.prior
        chunks = chunks_of(text)
        best = np.concatenate([self.pooled(chunks[i : i + GROUP])[0] for i in range(0, len(chunks), GROUP)])
        act = np.tanh(best + self.bias)
        logit = float(np.concatenate([act.mean(0), act.max(0)]) @ self.out + self.out_bias)
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def train(rows: list[tuple[int, str, int]], share: float | None = None, epochs: int = EPOCHS, seed: int = 3) -> Network:
    """``share``: of class 1 among all learnable rows."""
    labels = [int(y) for _, _, y in rows]
    rng = np.random.default_rng(seed)
    net = Network((rng.normal(size=(WIDTH, 256, FILTERS)) * 0.15).astype(np.float32), np.zeros(FILTERS, np.float32), (rng.normal(size=2 * FILTERS) * 0.2).astype(np.float32), 0.0)
    if len(set(labels)) < 2:
        net.prior = float(labels[0]) if labels else 0.5
        return net
    here = sum(labels) / len(labels)
    share = here if share is None else share
    weight = {1: (share / here) ** 0.5, 0: ((1 - share) / (1 - here)) ** 0.5}
    data = [(chunks_of(text), y) for (_, text, _), y in zip(rows, labels)]
    cut = random.Random(seed)
    for (_, text, _), y in zip(rows, labels):  # a short text is not a bad one: passages of good texts are good
        if y == 1 and text:
            start, size = cut.randrange(len(text)), cut.choice((8, 20, 50, 120, 300))
            data.append((chunks_of(text[start : start + size].strip()), 1))
    memory = [np.full_like(net.table, 1e-3), np.full_like(net.bias, 1e-3), np.full_like(net.out, 1e-3), 1e-3]
    order, shuffle = list(range(len(data))), random.Random(seed)
    filters = np.arange(FILTERS)
    for epoch in range(epochs):
        shuffle.shuffle(order)
        rate = RATE / (1 + epoch / 2)
        for i in order:
            chunks, y = data[i]
            best, at = net.pooled(chunks)
            act = np.tanh(best + net.bias)
            n = len(chunks)
            top = act.argmax(0)
            hidden = np.concatenate([act.mean(0), act[top, filters]])
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_bias, -30, 30)))
            error = float(p - y) * weight[y]
            d_act = np.repeat(net.out[None, :FILTERS] * error / n, n, 0)
            d_act[top, filters] += net.out[FILTERS:] * error
            d_sum = d_act * (1 - act * act)
            d_out = error * hidden
            memory[2] += d_out * d_out
            net.out -= rate * d_out / np.sqrt(memory[2])
            memory[3] += error * error
            net.out_bias -= rate * error / memory[3] ** 0.5
            d_bias = d_sum.sum(0)
            memory[1] += d_bias * d_bias
            net.bias -= rate * d_bias / np.sqrt(memory[1])
            row, col = np.repeat(np.arange(n), FILTERS), np.tile(filters, n)
            places, grads = at.ravel() * STRIDE, d_sum.ravel()
            for k in range(WIDTH):
                spot = (k, chunks[row, places + k], col)
                np.add.at(memory[0], spot, grads * grads)
                np.add.at(net.table, spot, -rate * grads / np.sqrt(memory[0][spot]))
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1)")
    counts = {r[0]: r[1] for r in known.filter(~held_out()).groupBy("quality").count().collect()}
    total = sum(counts.values())
    return train(labelled_sample(docs, known, "quality", per_class, MAX_CHARS), counts.get(1, 0) / total if total else None)


def classify(docs: DataFrame, labels: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    net = fit(docs, labels) if net is None else net

    def run(batches):
        release()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([net.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    arrow_rows(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: Network) -> DataFrame:
    """The rows that score ``THRESHOLD`` or more, all columns as they are."""
    at = docs.columns.index("text")

    def run(batches):
        release()
        for batch in slices(batches):
            yield batch.filter(pa.array([net.score(t) >= THRESHOLD for t in batch.column(at).to_pylist()], pa.bool_()))

    arrow_rows(docs.sparkSession)
    return map_rows(docs, run)
