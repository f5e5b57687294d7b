"""Line dedup: overlapping windows of three lines, repeated anywhere in the corpus.

Lines are the parts of a text between ``\\n``; those that hold a word count, compared without
white space at their ends. Each three consecutive ones are a window, known by two 64-bit hashes.
Of all places of a window the first in the order of (id, hash of id and text, place) stays. Every
later place is covered, the covered ranges of a document are merged, and their lines are removed.

Windows are counted with partial sums, never listed, so a window in a third of all documents is
one row. Documents meet their ranges in one shuffle.

Defined cases: texts with fewer than three lines that hold a word stay as they are, so do null
and empty ones; lines without a word are kept, except between removed lines; rows equal in id and
text are one document and are treated alike; a null id sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lexalia.llm import rows as R, words as W

WINDOW = 3


class Lines:
    """Word-holding lines of a slice of texts: byte ranges without outer white space, first line of each text."""

    def __init__(self, words: W.Words):
        self.start, self.end, self.first = W.runs(words.data != 10, words.offsets)
        a = np.searchsorted(words.start, self.start)
        b = np.searchsorted(words.start, self.end)
        full = b > a
        self.whole_start, self.whole_end = self.start[full], self.end[full]
        self.start, self.end = words.start[a[full]], words.end[b[full] - 1]
        self.first = np.append(0, np.cumsum(full))[self.first]
        self.doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``_id``, key, ``_wa, _wb`` hashes, ``_at`` number of the window's first line."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_text"):
                words = W.Words(part.column("_text"))
                lines = Lines(words)
                h = W.byte_hashes(words.data, lines.start, lines.end)
                left = np.repeat(lines.first[1:], np.diff(lines.first)) - np.arange(len(h))
                at = np.flatnonzero(left >= size)
                doc = lines.doc[at]
                take = pa.array(doc, pa.int64())
                yield pa.record_batch(
                    [part.column("_id").take(take), part.column("_h").take(take), part.column("_g").take(take),
                     pa.array(W.signed(W.span_hashes(h, at, at + size, W.BASE_A)), pa.int64()),
                     pa.array(W.signed(W.span_hashes(h, at, at + size, W.BASE_B)), pa.int64()),
                     pa.array(at - lines.first[doc], pa.int64())], ["_id", *R.KEY, "_wa", "_wb", "_at"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(cut, f"_id {kind}, _h long, _g int, _wa long, _wb long, _at long")


def _drop_lines(data: np.ndarray, begin: int, end: int, starts: np.ndarray, ends: np.ndarray,
                number: np.ndarray) -> bytes:
    """Text bytes without the given lines; a run of consecutive numbers takes the blank lines between along."""
    pieces, at, i = [], begin, 0
    while i < len(number):
        j = i
        while j + 1 < len(number) and number[j + 1] == number[j] + 1:
            j += 1
        pieces.append(data[at:starts[i]].tobytes())
        at = min(int(ends[j]) + 1, end)  # with the line's own \n
        i = j + 1
    pieces.append(data[at:end].tobytes())
    text = b"".join(pieces)
    return text[:-1] if number[-1:].size and at >= end and text.endswith(b"\n") else text


def line_dedup(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
               keep_columns: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """``id_col, keep_columns, n_lines`` (with a word)``, n_removed, kept_text`` of every document.

    ``prefix`` goes before the last three names, where ``keep_columns`` has such names.
    """
    keys = R.keyed(docs, id_col, text_col)
    found = R.stage(windows(keys, size), "line-windows")
    place = F.struct("_id", *R.KEY, "_at")
    firsts = found.groupBy("_wa", "_wb").agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    # Written, so that the join deals out both sides and Spark can split a window with many places.
    firsts = R.stage(firsts.where("_n > 1"), "first-places")
    later = found.join(firsts, ["_wa", "_wb"]).where(place != F.col("_first"))
    per_doc = later.groupBy(*R.KEY).agg(F.collect_set("_at").alias("_later"))

    carried = [c for c in keep_columns if c not in (id_col, text_col)]
    rows = R.bounded(docs).select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)], F.col(id_col).alias("_id"),
                       *R.key(id_col, text_col), F.col(text_col).cast("string").alias("_text"))
    # Hashed, not sorted: sorting would hold whole texts, the ranges are far smaller.
    rows = rows.join(per_doc.hint("shuffle_hash"), R.KEY, "left").select(
        *[f"_c{i}" for i in range(len(carried))], "_id", "_text", "_later")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_text"):
                words = W.Words(part.column("_text"))
                lines = Lines(words)
                given = part.column("_text")
                later = part.column("_later")
                texts, removed = [], np.zeros(part.num_rows, np.int64)
                for d in range(part.num_rows):
                    at = later[d].as_py()
                    if not at:
                        texts.append(given[d].as_py())
                        continue
                    gone = np.unique(np.add.outer(np.array(at), np.arange(size)))
                    own = lines.first[d] + gone
                    removed[d] = len(gone)
                    texts.append(_drop_lines(words.data, words.offsets[d], words.offsets[d + 1],
                                             lines.whole_start[own], lines.whole_end[own], gone).decode("utf-8"))
                yield pa.record_batch(
                    [*part.columns[:-2], pa.array(np.diff(lines.first), pa.int64()), pa.array(removed),
                     pa.array(texts, pa.string())], names)

    names = [*carried, id_col, *[prefix + n for n in ("n_lines", "n_removed", "kept_text")]]
    kinds = [*rows.schema.fields[:-2], T.StructField("", T.LongType()), T.StructField("", T.LongType()),
             T.StructField("", T.StringType())]
    return rows.mapInArrow(rebuild, T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, kinds)]))
