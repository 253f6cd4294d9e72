"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams.

Features of a text: the set of its words, word pairs and pairs of words with
one word between (skip-grams), lower-cased and hashed to ``2**BITS`` slots.
Training runs the FTRL-proximal updates (per-coordinate rates, L1 sparsity)
on a bounded sample: at most ``TRAIN_ROWS`` labelled documents, the first in
the order of a hash of doc_id, so the bound and not the corpus sets the size
of the one training task.  The result is a sparse weight table of at most
``2**BITS`` entries (a fixed bound, in practice a few thousand) which goes to
the scoring tasks; scoring is one row-wise pass over whole texts.

Defined results: null or empty texts have no feature and get the score of the
bias; a null doc_id is not held out and has no label; if labels repeat for a
doc_id, the largest counts; labels without a 0 or 1 are not used; without any
usable label every score is 0.5; an empty table gives no row; columns of the
documents named ``score`` or ``predicted`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm import textarrays as ta
from foldwise.llm.frames import annotate

BITS = 20
TRAIN_ROWS = 16_000            # bound of the labelled sample
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.1
FOLDS, HELD = 5, 0


def is_held_out(doc_id: str = "doc_id"):
    """Column: crc32 of doc_id as text leaves the remainder of the held-out fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def _pairs(words: np.ndarray, gap: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ta.mix(words[:-gap] * ta.U64(0xA24BAED4963EE407) + words[gap:] * ta.U64(0x9FB21C651E98DF25 + 2 * salt))


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, row) of every feature occurrence of a slice, repeats included."""
    starts, ends, offsets = ta.word_spans(data, bounds, ta.ALNUM)
    words = ta.span_hashes(data, starts, ends, lower=True)
    rows = ta.rows_of(offsets).astype(np.int32)
    slots, owner = [words], [rows]
    for gap in (1, 2):
        if len(words) > gap:
            ok = rows[gap:] == rows[:-gap]
            slots.append(_pairs(words, gap, gap)[ok])
            owner.append(rows[:-gap][ok])
    return (np.concatenate(slots) >> ta.U64(64 - BITS)).astype(np.int32), np.concatenate(owner)


def feature_sets(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The distinct slots of each row of a slice."""
    slots, rows = features(data, bounds)
    key = ta.distinct(rows.astype(np.int64) << BITS | slots)
    edge = np.searchsorted(key, np.arange(len(bounds)) << BITS)
    flat = (key & (1 << BITS) - 1).astype(np.int32)
    return [flat[a:b] for a, b in zip(edge[:-1], edge[1:])]


class FtrlProximal:
    """Per-coordinate FTRL-proximal for binary features; slot 2**BITS is the bias."""

    def __init__(self, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, slots: np.ndarray) -> np.ndarray:
        z = self.z[slots]
        l1 = np.where(slots == 1 << BITS, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[slots])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def update(self, slots: np.ndarray, label: int) -> None:
        slots = np.append(slots, 1 << BITS)
        w = self.weights(slots)
        p = 1.0 / (1.0 + np.exp(-min(max(float(w.sum()), -35.0), 35.0)))
        g = p - label
        n = self.n[slots]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[slots] += g - sigma * w
        self.n[slots] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        slots = np.arange((1 << BITS) + 1)
        w = self.weights(slots)
        used = np.flatnonzero(w)
        return used, w[used]


def _sample(docs: DataFrame, labels: DataFrame, text: str, limit: int) -> DataFrame:
    """At most ``limit`` (text, label) rows outside the held-out fold."""
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = (labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y"))
              .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
              .groupBy("_id").agg(F.max("_y").alias("_y"))
              .where(~is_held_out("_id")).orderBy(*order).limit(limit))
    rows = docs.select(F.col("doc_id").alias("_id"), F.col(text).alias("_text"))
    # `chosen` has at most TRAIN_ROWS rows of two numbers: a fixed bound
    return rows.join(F.broadcast(chosen), "_id").orderBy(*order, F.xxhash64("_text")).limit(limit)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", limit: int = TRAIN_ROWS,
          epochs: int = EPOCHS, **rates) -> tuple[np.ndarray, np.ndarray]:
    """Fitted sparse weights as (slots, values)."""
    def fit(batches):
        sets, y = [], []
        for batch in batches:
            data, bounds = ta.column_bytes(batch.column(0))
            for lo, hi in ta.slices(bounds):
                sets += feature_sets(data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo])
            y += batch.column(1).to_pylist()
        model = FtrlProximal(**rates)
        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(len(y)).tolist():
                model.update(sets[i], y[i])
        slots, values = model.sparse()
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(values)], names=["slot", "weight"])

    fitted = (_sample(docs, labels, text, limit).select("_text", "_y").coalesce(1)
              .mapInArrow(fit, "slot int, weight double").toArrow())
    return fitted.column(0).to_numpy(), fitted.column(1).to_numpy()


def score(docs: DataFrame, slots: np.ndarray, values: np.ndarray, text: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with score (0 to 1) and predicted."""
    slots, values = np.asarray(slots, np.int32), np.asarray(values, np.float64)

    def make():
        weight = np.zeros((1 << BITS) + 1)
        weight[slots] = values
        used = weight != 0
        bias = weight[-1]

        def compute(batch: pa.RecordBatch) -> list:
            data, bounds = ta.column_bytes(batch.column(0))
            logit = np.full(len(bounds) - 1, bias)
            for lo, hi in ta.slices(bounds):
                slot, row = features(data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo])
                on = used[slot]
                key = ta.distinct(row[on].astype(np.int64) << BITS | slot[on])
                logit[lo:hi] += np.bincount(key >> BITS, weight[key & (1 << BITS) - 1], minlength=hi - lo)
            p = 1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35)))
            return [p, (p >= 0.5).astype(np.int32)]
        return compute

    return annotate(docs, {"text": f"`{text}`"}, [("score", "double"), ("predicted", "int")], make, keep)
