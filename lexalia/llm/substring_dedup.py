"""Substring dedup: relative Lempel-Ziv parsing of documents against all reference blocks.

Every document is both text to parse and reference. Passages of at least ``window`` words that
stand anywhere else (in the same document too) become duplicate spans and are removed wherever
they stand.

* Reference blocks. Each window of words owns an anchor: its smallest five-word hash. Windows that
  follow one another and own the same anchor form a block. Equal windows own equal anchors and so
  lie in blocks with one anchor: the anchor is the index of the reference.
* Parsing. A document is its sequence of blocks, left to right. A block whose anchor is indexed
  nowhere else has no factor. A block that stands elsewhere word for word is copied whole: the
  greedy factor runs on to the next block, and consecutive blocks give one long factor.
* Factor boundaries. Where blocks share the anchor but differ, a factor begins or ends inside the
  block. Only there are single windows compared, one representative for each distinct block.

Blocks are equal if anchor and block hashes agree, windows if two 64-bit hashes do (128 bits).
A group of copies is counted, never listed. Texts are shuffled by key twice from one exchange:
for the blocks at factor boundaries, and for the result.

Defined cases: a null or empty text has no words and nothing to remove; texts shorter than a
window are kept; repeated rows are copies of each other, so their windows are all removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexalia.llm import rows as R, words as W

WINDOW, ANCHOR = 35, 5
#: A block is written as ``64 * first window + (last window - first window)``.
_PACK = 64


def _blocks(words: W.Words, window: int) -> tuple[np.ndarray, ...]:
    """Document, first and last window start, anchor hash and block hash of each block."""
    at = words.windows(window)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    begin = np.arange(len(words.start) - ANCHOR + 1)
    grams = W.span_hashes(words.hash, begin, begin + ANCHOR, W.BASE_A)
    choice = np.lib.stride_tricks.sliding_window_view(grams, window - ANCHOR + 1).argmin(axis=1)
    anchor = at + choice[at]
    doc = words.doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(anchor) != 0) | (np.diff(at) != 1) | (np.diff(doc) != 0)
    opens = np.flatnonzero(new)
    first, last = at[opens], at[np.append(opens[1:], len(at)) - 1]
    return doc[opens], first, last, grams[anchor[opens]], W.span_hashes(words.hash, first, last + window, W.BASE_B)


def blocks(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Key, ``_a`` anchor hash, ``_b`` block hash, ``_at`` place in the document."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_text"):
                words = W.Words(part.column("_text"))
                doc, first, last, anchor, block = _blocks(words, window)
                at = (first - words.first[doc]) * _PACK + (last - first)
                take = pa.array(doc, pa.int64())
                yield pa.record_batch(
                    [part.column("_h").take(take), part.column("_g").take(take),
                     pa.array(W.signed(anchor), pa.int64()), pa.array(W.signed(block), pa.int64()),
                     pa.array(at, pa.int64())], [*R.KEY, "_a", "_b", "_at"])

    return docs.select(*R.KEY, "_text").mapInArrow(parse, "_h long, _g int, _a long, _b long, _at long")


def boundary_windows(docs: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """Both hashes and the place of every window of the chosen blocks; ``_alone``: the block stands once."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_text"):
                words = W.Words(part.column("_text"))
                found = part.column("_blocks")
                flat = found.flatten()
                doc = np.repeat(np.arange(part.num_rows), found.value_lengths().to_numpy())
                at = flat.field("at").to_numpy()
                alone = flat.field("alone").to_numpy(zero_copy_only=False)
                first = words.first[doc] + at // _PACK
                size = at % _PACK + 1
                doc, alone = np.repeat(doc, size), np.repeat(alone, size)
                begin = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                take = pa.array(doc, pa.int64())
                yield pa.record_batch(
                    [part.column("_h").take(take), part.column("_g").take(take),
                     pa.array(W.signed(W.span_hashes(words.hash, begin, begin + window, W.BASE_A)), pa.int64()),
                     pa.array(W.signed(W.span_hashes(words.hash, begin, begin + window, W.BASE_B)), pa.int64()),
                     pa.array(begin - words.first[doc], pa.int64()), pa.array(alone, pa.bool_())],
                    [*R.KEY, "_wa", "_wb", "_start", "_alone"])

    per_doc = chosen.groupBy(*R.KEY).agg(
        F.collect_set(F.struct(F.col("_at").alias("at"), F.col("_alone").alias("alone"))).alias("_blocks"))
    # Equal rows give their windows twice; these are repeated windows in any case.
    rows = docs.join(per_doc, R.KEY).select(*R.KEY, "_text", "_blocks")
    return rows.mapInArrow(cut, "_h long, _g int, _wa long, _wb long, _start long, _alone boolean")


def remove(docs: DataFrame, ranges: DataFrame, keep_text: bool) -> DataFrame:
    """Documents without the words of ``ranges`` (key, ``_from, _to`` in words)."""
    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_text"):
                words = W.Words(part.column("_text"))
                found = part.column("_ranges")
                flat = found.flatten()
                doc = np.repeat(np.arange(part.num_rows), found.value_lengths().fill_null(0).to_numpy())
                cover = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(cover, words.first[doc] + flat.field("a").to_numpy(), 1)
                np.add.at(cover, words.first[doc] + flat.field("b").to_numpy(), -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed = W.per_part(gone, words.first)
                starts, ends, first = W.runs(gone, words.first)
                digest, texts, spans = [], [], []
                for d in range(part.num_rows):
                    lo, pieces, own = words.first[d], [], []
                    for a, b in zip(starts[first[d]:first[d + 1]], ends[first[d]:first[d + 1]]):
                        pieces.append(words.joined(lo, a))
                        own.append({"a": int(a - words.first[d]), "b": int(b - words.first[d])})
                        lo = b
                    pieces.append(words.joined(lo, words.first[d + 1]))
                    text = b" ".join(x for x in pieces if x)
                    digest.append(hashlib.sha256(text).hexdigest())
                    spans.append(own)
                    texts.append(text.decode("utf-8", "replace") if keep_text else None)
                yield pa.record_batch(
                    [part.column("_id"), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(digest, pa.string()),
                     pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                     pa.array(texts, pa.string())],
                    ["_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"])

    per_doc = ranges.groupBy(*R.KEY).agg(
        F.collect_set(F.struct(F.col("_from").alias("a"), F.col("_to").alias("b"))).alias("_ranges"))
    none = F.array().cast("array<struct<a: bigint, b: bigint>>")
    rows = docs.join(per_doc, R.KEY, "left").select("_id", "_text", F.coalesce("_ranges", none).alias("_ranges"))
    kind = docs.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(
        rebuild, f"_id {kind}, n_words long, n_removed long, kept_sha256 string, "
                 "spans array<struct<a: long, b: long>>, kept_text string")


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                    keep_text: bool = True) -> DataFrame:
    """``id_col, n_words, n_removed, kept_sha256, spans, kept_text`` of every document.

    ``window`` at most 64 + ``ANCHOR`` - 1 words. ``spans`` are the factors removed, as word ranges.
    """
    if not ANCHOR <= window < _PACK + ANCHOR:
        raise ValueError(f"window must be from {ANCHOR} to {_PACK + ANCHOR - 1} words")
    docs = R.keyed(docs, id_col, text_col)
    found = blocks(docs, window)
    # What the joins meet is written, so that they deal out both sides and Spark can split a hot anchor.
    indexed = R.stage(found.groupBy("_a").count().where("count > 1").select("_a"), "anchors")
    shared = R.stage(found.join(indexed, "_a", "left_semi"), "shared-blocks")
    distinct = R.stage(shared.groupBy("_a", "_b").agg(
        F.count("*").alias("_n"), F.min(F.struct(*R.KEY, "_at")).alias("_one")), "distinct-blocks")
    several = R.stage(distinct.groupBy("_a").count().where("count > 1").select("_a"), "boundary-anchors")
    chosen = distinct.join(several, "_a", "left_semi").select(
        "_one._h", "_one._g", "_one._at", (F.col("_n") == 1).alias("_alone"))
    windows = R.stage(boundary_windows(docs, chosen, window), "boundary-windows")
    repeated = R.stage(windows.groupBy("_wa", "_wb").count().where("count > 1").select("_wa", "_wb"), "repeated")
    inside = (windows.where("_alone").join(repeated, ["_wa", "_wb"], "left_semi")
              .select(*R.KEY, F.col("_start").alias("_from"), (F.col("_start") + window).alias("_to")))
    start = F.floor(F.col("_at") / _PACK)
    whole = (shared.join(distinct.where("_n > 1").select("_a", "_b"), ["_a", "_b"], "left_semi")
             .select(*R.KEY, start.alias("_from"),
                     (start + F.col("_at") % _PACK + window).alias("_to")))
    return remove(docs, whole.unionByName(inside), keep_text).withColumnRenamed("_id", id_col)
