"""Quality rules: word counts, and a linear-chain conditional random field over lines.

Every line of a text is content or boilerplate. The field scores a line by its shape (symbols,
exclamation marks, capitals, digits, length) and neighbouring lines by a transition weight;
Viterbi decoding finds the best labelling, and the share of word characters in content lines
decides whether the document is retained.

Training: maximum a posteriori, by gradient steps on the exact likelihood (forward-backward),
on at most ``SAMPLE_DOCS`` labelled documents of at most ``SAMPLE_LINES`` lines, chosen by a hash
of the id; all lines of a sampled document carry its quality label. The prior is centred on
``PRIOR``, so without any label the field is the prior itself.

Defined cases: a null or empty text has no words, fails the base rule and is not kept. Ids may
be null or repeated; every row is judged by itself. One row may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lexalia.llm import rows as R, words as W

SAMPLE_DOCS, SAMPLE_LINES = 1000, 200
KEEP_SHARE = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_CAPITAL, _SMALL = W.byte_set((0x41, 0x5A)), W.byte_set((0x61, 0x7A), (0x80, 0xFF))
_DIGIT = W.byte_set((0x30, 0x39))
_STOPS = np.isin(np.arange(256), list(b".?!:;"))

#: Features of a line and the prior mean of their weight for the label "content".
PRIOR = {"bias": 2.0, "symbols_per_word": -4.0, "exclamations_per_word": -4.0, "capital_share": -3.0,
         "digit_share": -2.0, "ends_with_stop": 0.0, "log_words": 0.0, "word_length": 0.0}
PRIOR_STAY, PRIOR_VARIANCE, STEPS, RATE = 0.5, 4.0, 120, 0.1


class Lines:
    """The ``\\n``-split lines of a slice of texts."""

    def __init__(self, words: W.Words):
        newlines = np.flatnonzero(words.data == 10)
        self.start = np.sort(np.concatenate([words.offsets[:-1], newlines + 1]))
        self.end = np.sort(np.concatenate([newlines, words.offsets[1:]]))
        per_doc = 1 + np.diff(np.searchsorted(newlines, words.offsets))
        self.first = np.concatenate([[0], np.cumsum(per_doc)])
        self.doc = np.repeat(np.arange(len(per_doc)), per_doc)
        self.word = np.searchsorted(words.start, np.append(self.start, len(words.data)))
        self.n_words = np.searchsorted(words.start, self.end) - self.word[:-1]


def _between(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[end] - sums[start]


def line_features(words: W.Words, lines: Lines) -> np.ndarray:
    """One row per line, columns as in ``PRIOR``."""
    count = lambda table: _between(table[words.data], lines.start, lines.end)
    n = np.maximum(lines.n_words, 1)
    capitals, small, chars = count(_CAPITAL), count(_SMALL), count(W.SPACED)
    marks = _between(words.data == 0x21, lines.start, lines.end)
    last = np.clip(np.searchsorted(words.start, lines.end) - 1, 0, None)
    ends = np.zeros(len(n), bool)
    if len(words.start):
        ends = _STOPS[words.data[words.end[last] - 1]] & (lines.n_words > 0)
    return np.column_stack([
        np.ones(len(n)), np.minimum(count(_SYMBOLS) / n, 2), np.minimum(marks / n, 2),
        capitals / np.maximum(capitals + small, 1), count(_DIGIT) / np.maximum(chars, 1), ends,
        np.log1p(lines.n_words) / 4, np.minimum(chars / n, 40) / 20])


def _blocks(first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each line number t: the sequences with more than t lines (longest first) and those lines."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")
    return [(order[:k], first[order[:k]] + t) for t, k in enumerate(live)]


def viterbi(score: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Best 0/1 label of each line; ``score`` is that of label 1 against 0. Ties give content."""
    best, back = np.zeros((len(first) - 1, 2)), np.zeros((len(score), 2), np.int8)
    blocks = _blocks(first)
    for t, (seq, line) in enumerate(blocks):
        if t:
            ways = best[seq][:, :, None] + transition
            back[line] = 1 - np.argmax(ways[:, ::-1], axis=1)
            best[seq] = ways.max(axis=1)
        best[seq, 1] += score[line]
    label, state = np.zeros(len(score), np.int8), np.where(best[:, 1] >= best[:, 0], 1, 0)
    for seq, line in reversed(blocks):
        label[line] = state[seq]
        state[seq] = back[line, state[seq]]
    return label


def marginals(score: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label 1) of each line, and expected counts of the transitions summed over sequences."""
    blocks, n = _blocks(first), len(first) - 1
    alpha, beta = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    own = np.column_stack([np.zeros(len(score)), score])
    for t, (seq, line) in enumerate(blocks):
        alpha[line] = own[line]
        if t:
            alpha[line] += np.logaddexp.reduce(alpha[line - 1][:, :, None] + transition, axis=1)
    log_z = np.zeros(n)
    last = first[1:] - 1
    log_z[:] = np.logaddexp.reduce(alpha[last], axis=1)
    pairs = np.zeros((2, 2))
    for t in range(len(blocks) - 1, 0, -1):
        seq, line = blocks[t]
        ahead = own[line] + beta[line]
        beta[line - 1] = np.logaddexp.reduce(transition[None] + ahead[:, None, :], axis=2)
        pairs += np.exp(alpha[line - 1][:, :, None] + transition + ahead[:, None, :]
                        - log_z[seq][:, None, None]).sum(axis=0)
    doc = np.repeat(np.arange(n), np.diff(first))
    return np.exp(alpha[:, 1] + beta[:, 1] - log_z[doc]), pairs


def prior_weights() -> tuple[np.ndarray, np.ndarray]:
    return np.array(list(PRIOR.values())), PRIOR_STAY * np.eye(2)


def train(features: np.ndarray, first: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions from labelled sequences, ``labels`` one per line."""
    weights, transition = prior_weights()
    if not len(features):
        return weights, transition
    prior, base = weights.copy(), transition.copy()
    inner = np.ones(len(labels), bool)
    inner[first[:-1]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[np.flatnonzero(inner) - 1], labels[inner]), 1)
    n, size = len(first) - 1, len(weights)
    moment, square = np.zeros(size + 4), np.zeros(size + 4)
    for step in range(1, STEPS + 1):
        p, pairs = marginals(features @ weights, first, transition)
        gradient = np.concatenate([
            (features.T @ (labels - p) - (weights - prior) / PRIOR_VARIANCE) / n,
            ((seen - pairs - (transition - base) / PRIOR_VARIANCE) / n).ravel()])
        moment, square = 0.9 * moment + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        weights, transition = weights + move[:size], transition + move[size:].reshape(2, 2)
    return weights, transition


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Train on the bounded sample of labelled documents described above."""
    marked = (labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id"))
              .agg(F.max(label_col).cast("int").alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCS))
    few_lines = F.length(text_col) - F.length(F.replace(text_col, F.lit("\n"))) < SAMPLE_LINES
    sample = (R.bounded(docs).where(few_lines).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
              .join(marked, "_id").select("_y", "_text"))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_text"):
                words = W.Words(part.column("_text"))
                lines = Lines(words)
                flat = line_features(words, lines).astype(np.float32).ravel()
                yield pa.record_batch([part.column("_y"), W.lists(flat, lines.first * len(PRIOR), pa.float32())],
                                      ["y", "f"])

    rows = sample.mapInArrow(shapes, "y int, f array<float>").limit(SAMPLE_DOCS).collect()
    rows.sort(key=lambda r: (r.y, len(r.f), r.f))
    each = [np.array(r.f).reshape(-1, len(PRIOR)) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    target = np.repeat([r.y for r in rows], np.diff(first)).astype(np.int64)
    return train(np.concatenate(each) if each else np.zeros((0, len(PRIOR))), first, target)


_SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()), T.StructField("content_share", T.DoubleType())])


def _within(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes made different from text to text."""
    return W.mix(values + doc.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def measures(texts: pa.Array, weights: np.ndarray, transition: np.ndarray) -> list[np.ndarray]:
    """The columns of ``_SCHEMA`` for some texts."""
    words = W.Words(texts)
    lines = Lines(words)
    n_words = words.counts
    in_word = W.SPACED[words.data]
    chars = W.per_part(in_word & W.LEADING[words.data], words.offsets)
    symbols = W.per_part(_SYMBOLS[words.data], words.offsets)

    full = lines.n_words > 0
    key = _within(W.byte_hashes(words.data, lines.start, lines.end), lines.doc)[full]
    new = np.zeros(len(key), bool)
    new[np.unique(key, return_index=True)[1]] = True
    dup = np.bincount(lines.doc[full][~new], minlength=len(n_words))

    at = words.windows(3)
    _, which, times = np.unique(_within(W.span_hashes(words.hash, at, at + 3, W.BASE_A), words.doc[at]),
                                return_inverse=True, return_counts=True)
    at = at[times[which] > 1]
    cover = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + 3, -1)
    repeat = W.per_part(np.cumsum(cover[:-1]) > 0, words.first)

    label = viterbi(line_features(words, lines) @ weights, lines.first, transition)
    size = _between(in_word, lines.start, lines.end)
    total = np.bincount(lines.doc, size, len(n_words))
    share = np.bincount(lines.doc, size * label, len(n_words)) / np.maximum(total, 1)
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    return [n_words, chars, symbols, dup, repeat, failed, ~failed & (share >= KEEP_SHARE), share]


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  keep_columns: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """``id_col``, ``keep_columns`` and the measures of every document. Nothing is shuffled.

    ``prefix`` goes before the names of measures, where ``keep_columns`` has such names.
    """
    weights, transition = fit(docs, labels, id_col, text_col)
    carried = [id_col, *[c for c in keep_columns if c != id_col]]
    rows = R.bounded(docs).select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)],
                                  F.col(text_col).cast("string").alias("_measured"))
    measured = [T.StructField(prefix + f.name, f.dataType) for f in _SCHEMA]
    names = [f.name for f in measured]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_measured"):
                found = measures(part.column("_measured"), weights, transition)
                yield pa.record_batch([*part.columns[:-1], *map(pa.array, found)], [*carried, *names])

    kept = [T.StructField(c, f.dataType) for c, f in zip(carried, rows.schema.fields)]
    return rows.mapInArrow(judge, T.StructType([*kept, *measured]))
