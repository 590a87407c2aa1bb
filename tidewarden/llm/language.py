"""Operator 9: language identification.

Sparse multinomial logistic regression on TF-IDF weights of hashed character 1- to
3-grams (lower-cased, whole text), trained by follow-the-regularised-leader with
an elastic-net penalty on a bounded sample (sampling.py; ``PER_CLASS`` rows a
language), then calibrated by one temperature on the part of the sample that was
not trained on.  Prediction is one narrow pass with one model of fixed size.

A null text, or one without a letter, is ``und`` with score 0; so is every text
where nothing can be learned (no labelled rows, an empty table).  Ties between
languages go to the first in alphabetical order.  Repeated rows repeat.  A very long
text is counted whole, in overlapping stretches.  Only doc_id (for the fold) and text
are read when predicting; other columns, whatever their names, take no part.  An empty
table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forced_bpe import release
from .sampling import held_out, labelled_sample
from .storage import arrow_rows, map_rows
from .tokens import slices

SLOTS = 1 << 15
ORDERS = (1, 2, 3)
PER_CLASS = 700
MAX_CHARS = 50_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of the character n-grams of a text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(SLOTS, np.int64)
    for at in range(0, max(len(points), 1), 1 << 20):  # long texts in stretches that overlap by an n-gram
        part = points[at : at + (1 << 20) + max(ORDERS) - 1]
        for n in ORDERS:
            size = min(len(part) - n + 1, 1 << 20)
            if size > 0:
                h = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
                for k in range(n):
                    h = (h ^ part[k : k + size]) * np.uint32(0x85EBCA6B)
                    h ^= h >> np.uint32(15)
                total += np.bincount(h & np.uint32(SLOTS - 1), minlength=SLOTS)
    slots = np.flatnonzero(total)
    return slots, total[slots]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # slot x language
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        slots, counts = gram_counts(text)
        x = np.log1p(counts) * self.idf[slots]
        return slots, x / max(float(np.sqrt((x * x).sum())), 1e-12)

    def logits(self, slots: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[slots] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        p = softmax(self.logits(*self.vector(text)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max())
    return e / e.sum()


def train(rows: list[tuple[int, str, str]], epochs: int = EPOCHS) -> Model:
    languages = sorted({lang for _, _, lang in rows})
    k = len(languages)
    grams = [gram_counts(text) for _, text, _ in rows]
    seen = np.zeros(SLOTS)
    for slots, _ in grams:
        seen[slots] += 1
    model = Model(languages, np.log((1 + len(rows)) / (1 + seen)) + 1, np.zeros((SLOTS, k)), np.zeros(k))
    if k < 2:
        return model
    vectors = []
    for slots, counts in grams:
        x = np.log1p(counts) * model.idf[slots]
        vectors.append((slots, x / max(float(np.sqrt((x * x).sum())), 1e-12)))
    truth = [languages.index(lang) for _, _, lang in rows]
    z, n = np.zeros((SLOTS + 1, k)), np.zeros((SLOTS + 1, k))  # the last slot is the bias

    def weights(slots):
        own_z, own_n = z[slots], n[slots]
        return np.where(np.abs(own_z) > L1, -(own_z - np.sign(own_z) * L1) / ((BETA + np.sqrt(own_n)) / ALPHA + L2), 0.0)

    fit = [i for i in range(len(rows)) if i % 5]
    for _ in range(epochs):
        for i in fit:
            slots, x = np.append(vectors[i][0], SLOTS), np.append(vectors[i][1], 0.2)
            w = weights(slots)
            grad = softmax(x @ w)
            grad[truth[i]] -= 1
            g = x[:, None] * grad[None, :]
            own = n[slots]
            sigma = (np.sqrt(own + g * g) - np.sqrt(own)) / ALPHA
            z[slots] += g - sigma * w
            n[slots] = own + g * g
    every = weights(np.arange(SLOTS + 1))
    model.weights, model.bias = every[:SLOTS], every[SLOTS] * 0.2
    # temperature: the one of least log loss on the rows set aside
    aside = [(model.logits(*vectors[i]), truth[i]) for i in range(len(rows)) if i % 5 == 0]
    loss = lambda t: -sum(math.log(max(float(softmax(v / t)[y]), 1e-12)) for v, y in aside)
    model.temperature = min((2.0 ** (e / 4) for e in range(-32, 9)), key=loss)
    return model


def fit(docs: DataFrame, per_class: int = PER_CLASS) -> Model:
    return train(labelled_sample(docs, docs, "lang", per_class, MAX_CHARS))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    model = fit(docs) if model is None else model

    def run(batches):
        release()
        for batch in slices(batches):
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    arrow_rows(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows whose language is known with a probability of ``least`` or more, all columns as they are."""
    at = docs.columns.index("text")

    def good(text: str | None) -> bool:
        language, p = model.predict(text)
        return language != "und" and p >= least

    def run(batches):
        release()
        for batch in slices(batches):
            yield batch.filter(pa.array([good(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    arrow_rows(docs.sparkSession)
    return map_rows(docs, run)
