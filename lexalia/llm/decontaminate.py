"""Benchmark decontamination: an exact containment join with a prefix filter.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window). A
document contains a window if the window's words stand in it in order. Shingles of five words
(fewer in shorter windows) are the tokens of the join:

1. Shingles are ordered by rarity: by the number of documents they occur in, counted over all
   documents. A window one of whose shingles occurs nowhere is dropped.
2. For full containment one shingle, the rarest, is the necessary prefix of a window. Documents
   and windows meet on its hash only.
3. Length and position: the document needs as many words as the window, and the shingle's place
   must leave room for the window's words before and after it.
4. The item-sized window of the document is compared word by word.

Documents are tested in their own tasks against a bitmap of ``BITMAP_BITS`` bits (2 MB, whatever
the size of the benchmark); what passes meets the windows in a shuffled join, which is exact
however full the bitmap is. Texts are never shuffled.

Defined cases: a null or empty text has no words and no hits; null or repeated item ids count
once as an item (null as none); a window in several items counts for each; repeated documents
get equal rows; either table may be empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexalia.llm import rows as R, words as W

WINDOW, SHINGLE = 10, 5
BITMAP_BITS = 1 << 24


def _shingles(words: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    at = words.windows(size)
    return at, W.span_hashes(words.hash, at, at + size, W.BASE_A)


def item_windows(items: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """``_item, _window`` (words joined by spaces), ``_n`` words, ``_shingles`` hashes in order."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_text", 1 << 18):
                words = W.Words(part.column("_text"), W.ALNUM, lower=True)
                item, text, size, tokens = [], [], [], []
                names = part.column("_item").to_pylist()
                for d, n in enumerate(words.counts):
                    have = [words.word(i) for i in range(words.first[d], words.first[d + 1])]
                    width = min(window, n)
                    step = min(SHINGLE, n)
                    a = words.first[d] + np.arange(n - step + 1 if n else 0)
                    hashes = W.signed(W.span_hashes(words.hash, a, a + step, W.BASE_A))
                    for i in range(n - width + 1 if n else 0):
                        item.append(names[d])
                        text.append(b" ".join(have[i:i + width]).decode("utf-8", "replace"))
                        size.append(width)
                        tokens.append(hashes[i:i + width - step + 1])
                yield pa.record_batch([pa.array(item, pa.string()), pa.array(text, pa.string()),
                                       pa.array(size, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))],
                                      ["_item", "_window", "_n", "_shingles"])

    rows = items.select(F.col(item_col).cast("string").alias("_item"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(cut, "_item string, _window string, _n int, _shingles array<long>")


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """Bit ``hash mod BITMAP_BITS`` set for every hash; at most ``BITMAP_BITS / 32768`` rows are collected."""
    place = F.pmod(F.col(column), F.lit(BITMAP_BITS)) + 1
    blocks = (hashes.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p"))
              .groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect())
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in blocks:
        out[(row.b - 1) * 4096:row.b * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def _marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64(BITMAP_BITS - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def rarity(docs: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """``_s`` -> ``_df``, the number of documents with the shingle; none for shingles in no document."""
    bits = bitmap(shingles, "_s")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in W.slices(batch, "_text"):
                words = W.Words(part.column("_text"), W.ALNUM, lower=True)
                for size in sizes:
                    at, h = _shingles(words, size)
                    hit = _marked(bits, h)
                    pair = np.column_stack([W.signed(h[hit]), words.doc[at[hit]]])
                    found.append(np.unique(pair, axis=0)[:, 0])
            hashes, n = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
            yield pa.record_batch([pa.array(hashes, pa.int64()), pa.array(n, pa.int64())], ["_s", "_n"])

    seen = docs.select("_text").mapInArrow(count, "_s long, _n long").groupBy("_s").agg(F.sum("_n").alias("_df"))
    return seen.join(shingles, "_s", "left_semi")


def candidates(docs: DataFrame, prefixes: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """Every document with its number of words and the places of prefix shingles, with the words around."""
    bits = bitmap(prefixes, "_s")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_text"):
                words = W.Words(part.column("_text"), W.ALNUM, lower=True)
                at, h = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for size in sizes:
                    place, value = _shingles(words, size)
                    hit = _marked(bits, value)
                    at.append(place[hit])
                    h.append(value[hit])
                at, h = np.concatenate(at), np.concatenate(h)
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                doc = words.doc[at]
                lo = np.maximum(at - window, words.first[doc])
                hi = np.minimum(at + window, words.first[doc + 1])
                around = [" ".join(words.word(i).decode("utf-8", "replace") for i in range(a, b))
                          for a, b in zip(lo, hi)]
                found = pa.StructArray.from_arrays(
                    [pa.array(at - words.first[doc], pa.int64()), pa.array(W.signed(h), pa.int64()),
                     pa.array(at - lo, pa.int32()), pa.array(around, pa.string())],
                    ["at", "s", "lead", "around"])
                ends = np.searchsorted(at, words.first)
                yield pa.record_batch(
                    [part.column("_id"), part.column("_h"), part.column("_g"), pa.array(words.counts, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)],
                    ["_id", "_h", "_g", "_n_words", "_found"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(
        probe, f"_id {kind}, _h long, _g int, _n_words long, "
               "_found array<struct<at: long, s: long, lead: int, around: string>>")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_words, n_hit, n_items, items_sha256, contaminated, spans`` and the key.

    ``spans`` are the ranges of the windows found, in order. The key tells rows with one id apart.
    """
    docs = R.keyed(docs, id_col, text_col)
    of_items = R.stage(item_windows(items, window, item_col, item_text_col), "windows")
    windows = of_items.groupBy("_window").agg(F.first("_n").alias("_n"), F.first("_shingles").alias("_shingles"))
    tokens = windows.select("_window", "_n", F.posexplode("_shingles").alias("_k", "_s"))
    sizes = [r[0] for r in windows.select(F.least("_n", F.lit(SHINGLE)).alias("n")).distinct().collect()]
    known = R.stage(rarity(docs, tokens.select("_s").distinct(), sorted(sizes)), "rarity")
    order = F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "_s", "_k")
    prefixes = R.stage(
        tokens.join(known, "_s", "left").groupBy("_window", "_n").agg(F.min(order).alias("_r"))
        .where("_r.df > 0").select("_window", "_n", "_r._s", "_r._k"), "prefixes")

    rows = R.stage(candidates(docs, prefixes, sorted(sizes), window), "candidates")
    places = rows.where(F.size("_found") > 0).select(*R.KEY, "_n_words", F.inline("_found"))
    begin = F.col("lead") - F.col("_k")
    around = F.split("around", " ", -1)
    room = (begin >= 0) & (F.col("_n_words") >= F.col("_n")) & (begin + F.col("_n") <= F.size(around))
    same = F.array_join(F.slice(around, F.greatest(begin, F.lit(0)) + 1, F.col("_n")), " ") == F.col("_window")
    hits = (places.join(prefixes, places["s"] == prefixes["_s"]).where(room).where(same)
            .select(*R.KEY, "_window", (F.col("at") - F.col("_k")).alias("a"),
                    (F.col("at") - F.col("_k") + F.col("_n")).alias("b")))
    spans = (hits.groupBy(*R.KEY).agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("_spans")))
    names = (hits.select(*R.KEY, "_window").distinct()
             .join(of_items.where("_item IS NOT NULL").select("_window", "_item").distinct(), "_window")
             .groupBy(*R.KEY).agg(F.sort_array(F.collect_set("_item")).alias("_items")))
    out = rows.join(spans.join(names, R.KEY, "left"), R.KEY, "left")
    hit = F.coalesce(covered("_spans"), F.lit(0))
    items_of = F.coalesce("_items", F.array().cast("array<string>"))
    return out.select(
        F.col("_id").alias(id_col), F.col("_n_words").alias("n_words"), hit.cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        F.coalesce("_spans", F.array().cast("array<struct<a: bigint, b: bigint>>")).alias("spans"),
        *R.KEY)



def covered(column: str) -> Column:
    """Number of positions in the union of sorted ``(a, b)`` ranges, in one pass."""
    zero = F.lit(0).cast("long")

    def add(state, x):
        fresh = F.greatest(zero, x["b"] - F.greatest(x["a"], state["end"]))
        return F.struct(F.greatest(x["b"], state["end"]).alias("end"), (state["n"] + fresh).alias("n"))

    return F.aggregate(column, F.struct(zero.alias("end"), zero.alias("n")), add, lambda s: s["n"])
