"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised in tasks and cut into pieces where longer than a sequence. All that packing
needs is how many pieces there are of each length: a histogram of at most ``capacity`` numbers,
whatever the size of the corpus. On it, not on documents, the plan is made:

1. Martello-Toth reduction. For the longest piece still open, sets that dominate every other way to
   fill its sequence are fixed for good, in bulk: alone if nothing fits beside it; with the longest
   piece that fits if that fills the sequence exactly, if no two pieces fit beside it, or if no three
   fit and it is at least as long as the best two. What is fixed leaves the histogram.
2. Best fit, longest first, of the remainder, each piece into the sequence it fills most closely.

The plan is a list of patterns with multiplicities. Pieces of one length are numbered in parallel
(hash salts, then offsets from counts), and the number finds the sequence and place in the plan.
A plan has a few entries per length, so it is sent to the tasks; its size is checked first.

Defined cases: a null or empty text is the single id 0; repeated rows are packed as often as they
stand; rows of equal id, piece and content are interchangeable. An empty table has no sequences.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lexalia.llm import rows as R, words as W

CAPACITY, END = 2048, 0
SALTS = 256
PLAN_ROWS = 4_000_000
_CACHE, _CACHED_BYTES = 300_000, 48
_PLAIN = regex.compile(r"[\p{L}\p{N}\p{P}\p{S}]+")
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class WordTokenizer(dict):
    """Ids of words (as 32-bit numbers), for a tokenizer that never joins what white space parts.

    Words are looked up, first whole, then by their letter, digit and sign parts; only unseen parts
    reach the tokenizer's model. Words with rarer characters take the tokenizer's own full path.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__()
        self._full = Tokenizer.from_file(path)
        self._model = self._full.model
        self._parts: dict[str, bytes] = {}
        letters = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(letters)]
        table = {b: chr(b) for b in letters} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self._chars = [table[b] for b in range(256)]

    def _part(self, part: str) -> bytes:
        ids = self._parts.get(part)
        if ids is None:
            chars = part if part.isascii() else "".join([self._chars[b] for b in part.encode()])
            ids = array("I", [t.id for t in self._model.tokenize(chars)]).tobytes()
            if len(self._parts) >= _CACHE:
                self._parts.clear()
            if len(part) <= _CACHED_BYTES:
                self._parts[part] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        # Below U+0250 every letter, digit and sign is its own normal form.
        near = word.isascii() or max(text) < "\u0250"
        low = text.lower() if near else text
        if near and low.isalpha():
            ids = self._part(low)
        elif near and low[:-1].isalpha() and low[-1] in ".,":
            ids = self._part(low[:-1]) + self._part(low[-1])
        elif near and b"<|" not in word and _PLAIN.fullmatch(low):
            ids = b"".join([self._part(p) for p in _PARTS.findall(low)])
        else:
            ids = array("I", self._full.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) >= _CACHE:
            self.clear()
        if len(word) <= _CACHED_BYTES:
            self[word] = ids
        return ids

    def ids(self, text: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), np.uint32)


@functools.cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str, text_col: str,
           keep_ids: bool = False) -> DataFrame:
    """``_id, piece, start, length, ids_crc32`` and, on demand, ``ids`` of every piece."""
    rows = R.bounded(docs).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            for part in W.slices(batch, "_text"):
                data, offsets = W.raw_bytes(part.column("_text"))
                text = data.tobytes()
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for d, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                    ids = np.append(tokenizer.ids(text[a:b]), np.uint32(END)).astype("<u4", copy=False)
                    for k, lo in enumerate(range(0, len(ids), capacity)):
                        own = ids[lo:lo + capacity]
                        row.append(d)
                        piece.append(k)
                        start.append(lo)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                        if keep_ids:
                            kept.append(own.astype(np.int32))
                columns = [part.column("_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                           pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.record_batch(columns, names)

    names = ["_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    kinds = [rows.schema["_id"].dataType, T.IntegerType(), T.LongType(), T.LongType(), T.LongType(),
             T.ArrayType(T.IntegerType())]
    return rows.mapInArrow(cut, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))


class _Lengths:
    """Open pieces by length, with the largest one not above a bound."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.count[length] = n

    def largest(self, bound: int) -> int:
        below = np.flatnonzero(self.count[:bound + 1]) if bound > 0 else ()
        return int(below[-1]) if len(below) else 0

    def smallest(self, n: int) -> list[int]:
        """The ``n`` smallest open pieces (fewer if there are not so many)."""
        out: list[int] = []
        for length in np.flatnonzero(self.count)[:n]:
            out += [int(length)] * min(n - len(out), int(self.count[length]))
        return out


def _best_two(lengths: _Lengths, room: int) -> int:
    """Largest sum of two open pieces within ``room``; 0 if there are none."""
    there = np.flatnonzero(lengths.count[:room])
    if not len(there):
        return 0
    partner = np.searchsorted(there, room - there, "right") - 1
    best = 0
    for a, p in zip(there, partner):
        while p >= 0 and there[p] == a and lengths.count[a] < 2:
            p -= 1
        if p >= 0:
            best = max(best, int(a + there[p]))
    return best


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """Patterns fixed by dominance with their multiplicities, and the lengths that remain open."""
    lengths, fixed = _Lengths(counts, capacity), []
    longest = capacity
    while longest := lengths.largest(longest):
        n = int(lengths.count[longest])
        room = capacity - longest
        small = lengths.smallest(4)
        small.remove(longest) if longest in small else None
        if not small or small[0] > room:
            pattern, times = [longest], n
        else:
            lengths.count[longest] -= 1
            beside = lengths.largest(room)
            two = len(small) > 1 and small[0] + small[1] <= room
            three = len(small) > 2 and sum(small[:3]) <= room
            dominates = beside == room or not two or not three and beside >= _best_two(lengths, room)
            lengths.count[longest] += 1
            if not dominates:  # it stays in the instance, where shorter pieces have to reckon with it
                longest -= 1
                continue
            # In bulk: with fewer pieces left the same argument holds until either length runs out.
            pattern = [longest, beside]
            times = n // 2 if beside == longest else min(n, int(lengths.count[beside]))
        for length in pattern:
            lengths.count[length] -= times
        fixed.append((pattern, times))
    return fixed, {int(k): int(lengths.count[k]) for k in np.flatnonzero(lengths.count)}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best fit, longest first, of pieces given by length; equal sequences are handled together."""
    by_room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            rooms = [r for r in by_room if r >= length]
            if not rooms:
                fill, room, pattern, times = min(left, capacity // length), capacity, [], left
            else:
                room = min(rooms)
                pattern, times = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                fill = min(left, room // length)
            used = min(times, left // fill)
            if pattern and used < times:
                by_room[room].append((pattern, times - used))
            by_room[room - fill * length].append((pattern + [length] * fill, used))
            left -= used * fill
    return [pair for group in by_room.values() for pair in group]


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """The packing as runs: pieces ``rank`` to ``rank + n`` of a length stand at ``offset`` of sequences from ``first``."""
    fixed, rest = reduce_instance(counts, capacity)
    ranks, sequence = defaultdict(int), 0
    runs: list[tuple[int, int, int, int]] = []
    for pattern, times in fixed + best_fit(rest, capacity):
        offset = 0
        for length in pattern:
            runs.append((length, ranks[length], sequence, offset))
            ranks[length] += times
            offset += length
        sequence += times
    if len(runs) > PLAN_ROWS:
        raise ValueError(f"a plan of {len(runs)} runs is larger than {PLAN_ROWS}")
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "first": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
         text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32[, ids], sequence_id, offset``."""
    cut = R.stage(pieces(docs, tokenizer_path, capacity, id_col, text_col, keep_ids), "pieces")
    salt = F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")
    cut = cut.withColumn("_salt", salt)
    parts = cut.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = R.stage(parts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))), "piece-counts")
    counts = {r[0]: r[1] for r in parts.groupBy("length").agg(F.sum("_n")).collect()}
    runs = plan(counts, capacity)

    own = Window.partitionBy("length", "_salt").orderBy("_id", "piece", "ids_crc32")
    numbered = (cut.withColumn("_own", F.row_number().over(own) - 1)
                .join(parts.select("length", "_salt", "_base"), ["length", "_salt"])
                .withColumn("_rank", F.col("_base") + F.col("_own")))
    names = ["_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    numbered = numbered.select(*names, "_rank")
    key = runs["length"] << 44 | runs["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(runs["first"][at] + rank - runs["rank"][at], pa.int64()),
                 pa.array(runs["offset"][at], pa.int64())], [id_col, *names[1:], "sequence_id", "offset"])

    schema = T.StructType([
        *[T.StructField(id_col if f.name == "_id" else f.name, f.dataType) for f in numbered.schema.fields[:-1]],
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(place, schema)
