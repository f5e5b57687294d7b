"""Toxicity: cumulative-link ordinal regression on sparse text features.

Features are lower-cased words hashed to ``SLOTS`` slots, valued ``log(1 + count)`` over the whole
text. One weight vector is shared by all thresholds: P(grade > k) = sigmoid(w x - t_k), with
t_1 < t_2 < t_3. The result is the expected severity, the sum of these probabilities.

Labels say toxic or not; grades of severity for training are 0 for the others and 1, 2 or 3 for
toxic documents by the number of marked words, words whose slot stands far more often in
toxic documents, cut at the terciles of the sample. Training uses at most ``SAMPLE`` labelled rows
(smallest hash of the id) and the slots whose association with the label is significant.

Defined cases: a null or empty text has no features and the severity of the thresholds alone; labels
other than 0 and 1 are left out, of repeated labels the largest counts; without toxic labels all
severities are 0. Every row is scored by itself; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lexalia.llm import rows as R, words as W

SAMPLE = 8000
SLOTS = 1 << 20
GRADES = 3
MIN_DOCS, MIN_Z, MARKED = 5, 6.0, 2.0
STEPS, RATE, DECAY = 400, 0.05, 2e-5


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (text, slot) pairs and how often each stands."""
    words = W.Words(texts, W.ALNUM, lower=True)
    slot = (words.hash % np.uint64(SLOTS)).astype(np.int64)
    pair, n = np.unique(words.doc * SLOTS + slot, return_counts=True)
    return pair // SLOTS, pair % SLOTS, n


class Model:
    """Weights of the chosen slots and the ordered thresholds."""

    def __init__(self) -> None:
        self.slots = np.zeros(0, np.int64)
        self.weights = np.zeros(0)
        self.thresholds = np.full(GRADES, np.inf)

    def linear(self, doc: np.ndarray, slot: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
        if not len(self.slots):
            return np.zeros(size)
        at = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
        hit = self.slots[at] == slot
        return np.bincount(doc[hit], self.weights[at[hit]] * np.log1p(n[hit]), size)

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, one column per threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - z[:, None], -30, 30))) * np.isfinite(self.thresholds)

    def train(self, doc: np.ndarray, slot: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> None:
        size, bad = len(toxic), int(toxic.sum())
        if not bad or bad == size:
            return
        of, place = np.unique(slot, return_inverse=True)
        hot, all_ = np.bincount(place, toxic[doc]), np.bincount(place)
        p, q = (hot + 0.5) / (bad + 1), (all_ - hot + 0.5) / (size - bad + 1)
        mean = (all_ + 0.5) / (size + 1)
        z = (p - q) / np.sqrt(np.maximum(mean * (1 - mean), 1e-9) * (1 / bad + 1 / (size - bad)))
        chosen = (all_ >= MIN_DOCS) & (np.abs(z) >= MIN_Z)
        marked = chosen & (np.log(p / q) >= MARKED)
        self.slots = of[chosen]
        evidence = np.bincount(doc, n * marked[place], size)
        cuts = np.quantile(evidence[toxic == 1], [1 / 3, 2 / 3])
        grade = np.where(toxic == 1, 1 + (evidence > cuts[0]) + (evidence > cuts[1]), 0)

        new = np.cumsum(chosen) - 1
        used = chosen[place]
        row, col, value = doc[used], new[place[used]], np.log1p(n[used])
        w = np.zeros(len(self.slots))
        share = [max((grade > k).mean(), 1e-4) for k in range(GRADES)]
        free = np.array([np.log(1 / share[0] - 1), *[np.log(0.5)] * (GRADES - 1)])
        state = [np.zeros(len(w) + GRADES), np.zeros(len(w) + GRADES)]
        rows = np.arange(size)
        for step in range(1, STEPS + 1):
            self.thresholds = free[0] + np.append(0, np.cumsum(np.exp(free[1:])))
            up = self.above(np.bincount(row, w[col] * value, size))
            bound = np.column_stack([np.ones(size), up, np.zeros(size)])
            slope = np.column_stack([np.zeros(size), up * (1 - up), np.zeros(size)])
            p_own = np.maximum(bound[rows, grade] - bound[rows, grade + 1], 1e-12)
            d_z = (slope[rows, grade] - slope[rows, grade + 1]) / p_own
            d_t = np.zeros(GRADES + 2)
            np.add.at(d_t, grade, -slope[rows, grade] / p_own)
            np.add.at(d_t, grade + 1, slope[rows, grade + 1] / p_own)
            d_t = d_t[1:-1]
            tail = np.cumsum(d_t[::-1])[::-1]
            g = np.concatenate([np.bincount(col, d_z[row] * value, len(w)) / size - DECAY * w,
                                [tail[0] / size], tail[1:] * np.exp(free[1:]) / size])
            state[0] = 0.9 * state[0] + 0.1 * g
            state[1] = 0.999 * state[1] + 0.001 * g**2
            move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
            w, free = w + move[:len(w)], free + move[len(w):]
        self.weights = w
        self.thresholds = free[0] + np.append(0, np.cumsum(np.exp(free[1:])))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    marked = (labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id"))
              .agg(F.max(label_col).cast("int").alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE))
    sample = (R.bounded(docs).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
              .join(marked, "_id").select("_y", "_text"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_text"):
                doc, slot, n = features(part.column("_text"))
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                yield pa.record_batch([part.column("_y"), W.lists(slot, cut, pa.int32()), W.lists(n, cut, pa.int32())],
                                      ["y", "slot", "n"])

    rows = sample.mapInArrow(sparse, "y int, slot array<int>, n array<int>").limit(2 * SAMPLE).toArrow()
    model = Model()
    if rows.num_rows:
        rows = rows.combine_chunks()
        slot, n = rows.column("slot").combine_chunks(), rows.column("n").combine_chunks()
        doc = np.repeat(np.arange(rows.num_rows), slot.value_lengths().to_numpy())
        model.train(doc, slot.flatten().to_numpy().astype(np.int64), n.flatten().to_numpy().astype(np.int64),
                    rows.column("y").to_numpy())
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic") -> DataFrame:
    """``id_col, severity`` (0 to 3)``, grade`` (likeliest)``, toxic`` (grade 1 or more is likelier than not)."""
    model = fit(docs, labels, id_col, text_col, label_col)
    rows = R.bounded(docs).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_text"):
                up = model.above(model.linear(*features(part.column("_text")), part.num_rows))
                bound = np.column_stack([np.ones(len(up)), up, np.zeros(len(up))])
                yield pa.record_batch(
                    [part.column("_id"), pa.array(up.sum(axis=1), pa.float64()),
                     pa.array(np.argmax(-np.diff(bound), axis=1).astype(np.int32)), pa.array(up[:, 0] >= 0.5)],
                    [id_col, "severity", "grade", "toxic"])

    return rows.mapInArrow(score, T.StructType([
        T.StructField(id_col, rows.schema["_id"].dataType), T.StructField("severity", T.DoubleType()),
        T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]))
