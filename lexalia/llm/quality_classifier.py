"""Quality classifier: random-indexing vectors, pooled per document, and a two-layer network.

* Random indexing. Every token (a lower-cased word, or the shape of a word such as ``Aa`` or
  ``a#``) is hashed to a slot; a slot has a fixed sparse index vector of +1 and -1. The vector of a
  slot is the sum of the index vectors of its neighbours within ``REACH`` words, over all documents,
  brought to length one. The sums are whole numbers, so no order of tasks changes them.
* Pooling. A document is the mean of its words' vectors and the mean of its shapes' vectors, frequent
  slots weighing less. Tokens are counted over whole texts. As a mean knows neither order nor
  length, two numbers go with it: the logarithm of the number of words, and the share of words
  equal to the word before.
* A network with one hidden layer gives a logit; a temperature fitted on a fifth of the sample that
  the network has not seen turns it into a probability.

Vectors and frequencies use no labels and come from every document: a task hands on one row a slot
at most. Network and temperature are fitted on a sample of at most ``SAMPLE`` labelled ids, those with
the smallest hash, taken only from outside the held-out fold, with one text each (of repeated rows of
an id the text with the smallest hash). The slot table has a fixed size (``SLOTS`` vectors of ``SIZE``
numbers, 9 MB), so it can be sent to every task. Scoring shuffles nothing.

Defined cases: a null or empty text pools to zeros and is scored like any other; labels other
than 0 and 1 are left out; of repeated labels of an id the largest counts; without labels of both
kinds every score is the share of ones (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lexalia.llm import rows as R, words as W

SAMPLE = 6000
WORD_SLOTS, SHAPE_SLOTS, SIZE, REACH = 1 << 15, 1 << 12, 64, 2
SLOTS = WORD_SLOTS + SHAPE_SLOTS
#: Numbers that stand for a document: two means of vectors, its length, its immediate repetition.
WIDTH = 2 * SIZE + 2
HIDDEN, STEPS, RATE, DECAY = 32, 300, 0.02, 1e-3
COMMON = 1e-3
_SPAN = 1 << 14
#: Tokens whose surroundings, each number of which is at most 2 * REACH * 2 * 8, add up within 15 bits.
_ADDED = ((1 << 15) - 1) // (32 * REACH)
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3

_CLASS = np.arange(256).astype(np.uint8)
_CLASS[W.byte_set((0x61, 0x7A), (0x80, 0xFF))] = ord("a")
_CLASS[W.byte_set((0x41, 0x5A))] = ord("A")
_CLASS[W.byte_set((0x30, 0x39))] = ord("0")


def index_vectors() -> np.ndarray:
    """Eight entries of +1 or -1 in each slot's vector, drawn from a hash of the slot."""
    out = np.zeros((SLOTS, SIZE), np.int16)
    slot = np.arange(SLOTS, dtype=np.uint64)
    for k in range(8):
        h = W.mix(slot * np.uint64(8) + np.uint64(k + 1))
        np.add.at(out, (np.arange(SLOTS), (h % np.uint64(SIZE)).astype(np.int64)),
                  np.where(h >> np.uint64(63), 1, -1).astype(np.int16))
    return out


def slots(texts: pa.Array) -> tuple[W.Words, np.ndarray, np.ndarray]:
    """Words of some texts with the slots of their lower-cased form and of their shape."""
    words = W.Words(texts)
    form = W.byte_hashes(W.LOWER[words.data], words.start, words.end)
    kind = _CLASS[words.data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[words.start] = True
    place = np.append(0, np.cumsum(keep))
    shape = W.byte_hashes(kind[keep], place[words.start], place[words.end])
    return (words, (form % np.uint64(WORD_SLOTS)).astype(np.int64),
            (shape % np.uint64(SHAPE_SLOTS)).astype(np.int64) + WORD_SLOTS)


def _packed(x: np.ndarray) -> np.ndarray:
    """Four neighbouring small numbers as the digits, signed and to base 2**16, of one 64-bit number, which adds up as they do."""
    x = x.astype(np.int64).reshape(len(x), -1, 4)
    return x[..., 0] + (x[..., 1] << 16) + (x[..., 2] << 32) + (x[..., 3] << 48)


def _unpacked(x: np.ndarray) -> np.ndarray:
    """The digits, each of which must lie within 16 signed bits."""
    out = np.empty((*x.shape, 4), np.int64)
    for i in range(4):
        out[..., i] = x.astype(np.int16)
        x = (x - out[..., i]) >> 16
    return out.reshape(len(x), -1)


def _context(texts: pa.Array, index: np.ndarray, out: np.ndarray, seen: np.ndarray) -> None:
    """Add the index vectors (packed, or packed here) around every token to ``out`` and count tokens in ``seen``; all in whole numbers."""
    index = _packed(index) if index.shape[1] == SIZE else index
    words, form, shape = slots(texts)
    for lo in range(0, len(form), _SPAN):
        first, last = max(lo - REACH, 0), min(lo + _SPAN + REACH, len(form))
        doc = words.doc[first:last]
        own = index[form[first:last]] + index[shape[first:last]]
        around = np.zeros_like(own)
        for step in range(1, REACH + 1):
            around[:-step] += own[step:]
            around[step:] += own[:-step]
            other = np.flatnonzero(doc[step:] != doc[:-step])
            around[other] -= own[other + step]
            around[other + step] -= own[other]
        around = around[lo - first:lo - first + _SPAN]
        for slot in (form[lo:lo + _SPAN], shape[lo:lo + _SPAN]):
            order = np.argsort(slot.astype(np.uint16), kind="stable")
            opens = np.flatnonzero(np.diff(slot[order], prepend=-1))
            count = np.diff(np.append(opens, len(slot)))
            at = slot[order[opens]]
            seen[at] += count
            # So few tokens at a time that the sums fit into their digits.
            parts = -(-count // _ADDED)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            sums = _unpacked(np.add.reduceat(around[order], np.repeat(opens, parts) + nth * _ADDED, axis=0))
            out[at] += sums[nth == 0]
            np.add.at(out, np.repeat(at, parts)[nth > 0], sums[nth > 0])


class Model:
    """Slot vectors times their weights, the weights, network and temperature."""

    def __init__(self, vectors: np.ndarray, weight: np.ndarray, base: float = 0.5):
        self.vectors, self.weight, self.base = vectors * weight[:, None], weight, base
        self.layers: list[np.ndarray] | None = None
        self.temperature = 1.0

    def pooled(self, texts: pa.Array) -> np.ndarray:
        words, form, shape = slots(texts)
        out = np.zeros((len(texts), WIDTH), np.float32)
        full = np.flatnonzero(words.counts)
        if len(full):
            for i, own in enumerate((form, shape)):
                sums = np.add.reduceat(self.vectors[own], words.first[full])
                total = np.add.reduceat(self.weight[own], words.first[full])
                out[full, i * SIZE:(i + 1) * SIZE] = sums / np.maximum(total, 1e-6)[:, None]
        again = (form[1:] == form[:-1]) & (words.doc[1:] == words.doc[:-1])
        out[:, -2] = np.log1p(words.counts)
        out[:, -1] = np.bincount(words.doc[1:][again], minlength=len(texts)) / np.maximum(words.counts, 1)
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, spread, w1, b1, w2, b2 = self.layers
        return np.tanh((x - mean) / spread @ w1 + b1) @ w2 + b2

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.layers is None:
            return np.full(len(texts), self.base)
        z = self.logits(self.pooled(texts).astype(np.float64)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        fit, check = np.arange(len(y)) % 5 != 0, np.arange(len(y)) % 5 == 0
        mean, spread = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
        rng = np.random.default_rng(7)
        layers = [rng.normal(0, WIDTH ** -0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        moment, square = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
        data, target = (x[fit] - mean) / spread, y[fit]
        for step in range(1, STEPS + 1):
            w1, b1, w2, b2 = layers
            hidden = np.tanh(data @ w1 + b1)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -30, 30))) - target) / len(target)
            back = np.outer(error, w2) * (1 - hidden**2)
            slopes = [data.T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ error + DECAY * w2,
                      np.array([error.sum()])]
            for i, g in enumerate(slopes):
                moment[i] = 0.9 * moment[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g**2
                layers[i] = layers[i] - RATE * (moment[i] / (1 - 0.9**step)) / (
                    np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
        self.layers = [mean, spread, *layers]
        z, t = self.logits(x[check]), y[check]
        grid = np.exp(np.linspace(-2, 3, 101))
        loss = [np.logaddexp(0, np.where(t == 1, -1, 1) * z / g).mean() for g in grid] if len(t) else [0]
        self.temperature = float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Model:
    """Vectors from all documents; the network from the bounded sample of labelled ids outside the held-out fold."""
    marked = (labels.where(F.col(label_col).isin(0, 1)).where(R.crc_mod(F.col(id_col), FOLDS) != HELD_OUT)
              .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE))
    texts = R.bounded(docs).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    one = F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text"))).alias("_one")
    sample = texts.join(marked, "_id").groupBy("_id", "_y").agg(one).select("_y", F.col("_one._text").alias("_text"))

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, out, seen = _packed(index_vectors()), np.zeros((SLOTS, SIZE), np.int64), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in W.slices(batch, "_text", 1 << 19):
                _context(part.column("_text"), index, out, seen)
        used = np.flatnonzero(seen)
        yield pa.record_batch(
            [pa.array(used, pa.int32()), pa.array(seen[used], pa.int64()),
             W.lists(out[used].ravel(), np.arange(len(used) + 1) * SIZE, pa.int64())], ["slot", "n", "v"])

    sums = [F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(SIZE)]
    table = (texts.select("_text").mapInArrow(context, "slot int, n long, v array<bigint>").groupBy("slot")
             .agg(F.sum("n").alias("n"), *sums).collect())
    vectors, count = np.zeros((SLOTS, SIZE), np.float32), np.zeros(SLOTS)
    for row in table:
        count[row[0]], vectors[row[0]] = row[1], row[2:]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
    share = count / max(count[:WORD_SLOTS].sum(), 1)
    model = Model(vectors, np.where(count > 0, COMMON / (COMMON + share), COMMON).astype(np.float32))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_text", 1 << 19):
                x = model.pooled(part.column("_text"))
                yield pa.record_batch([part.column("_y"), W.lists(x.ravel(), np.arange(len(x) + 1) * WIDTH,
                                                                  pa.float32())], ["y", "x"])

    rows = sample.mapInArrow(pool, "y int, x array<float>").collect()
    rows.sort(key=lambda r: (r.x, r.y))
    y = np.array([r.y for r in rows], np.float64)
    if len(y):
        model.base = float(y.mean())
    if 0 < model.base < 1 and len(y) > 1:
        order = np.random.default_rng(3).permutation(len(y))
        model.train(np.array([r.x for r in rows], np.float64)[order], y[order])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, held_out, score, predicted`` of every document."""
    model = fit(docs, labels, id_col, text_col, label_col)
    rows = R.bounded(docs).select(F.col(id_col).alias("_id"), (R.crc_mod(F.col(id_col), FOLDS) == HELD_OUT).alias("_out"),
                       F.col(text_col).cast("string").alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_text", 1 << 19):
                p = model.score(part.column("_text"))
                yield pa.record_batch([part.column("_id"), part.column("_out"), pa.array(p, pa.float64()),
                                       pa.array((p >= threshold).astype(np.int32))],
                                      [id_col, "held_out", "score", "predicted"])

    return rows.mapInArrow(score, T.StructType([
        T.StructField(id_col, rows.schema["_id"].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
