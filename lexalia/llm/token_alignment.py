"""Cross-tokenizer alignment: which ids of one vocabulary stand where ids of another stand.

Two lossless tokenizers cut the same bytes differently. Where both end a token they cut the text into
*groups*; tokens of A and B whose bytes overlap are *linked*. An id pair is scored by its links in the
whole corpus, by **inverted pair bitmaps**: documents are numbered in chunks of 2**16 slots, and every
id pair has for each chunk a compressed bitmap of its documents (gaps, slots or bits, whichever is
shortest) and, for repeated links, one bitmap per bit of the multiplicity less one. Partial bitmaps of a
pair are merged by OR; population counts give its documents and links. The postings then carry the
pair's score back to their documents.

A chunk belongs to the task that read its documents and holds a bounded number of postings, so a pair in
every document is many rows of at most 8 kB a plane, dealt out by pair and chunk. Only a table with one
row per B id is broadcast. Parsed texts, bitmaps and pair scores are written tables.

Defined cases: null and empty texts, and texts whose tokens do not spell a space and the text (for
example where a tokenizer normalises), have no tokens: counts 0 and an empty digest. Repeated rows are
documents of their own. Ids may be null or repeated; they are only carried. Kept columns may have any
names but those this operator returns. Memory grows with the longest text, not with the number of rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from lexalia.llm import rows as R, words as W

SLOTS = 1 << 16
#: Forms of a compressed bitmap.
GAPS, LISTED, BITS = 0, 1, 2
#: Postings after which partial bitmaps are handed on, and after which a chunk ends.
FLUSH, CHUNK = 1 << 20, 1 << 22
SLICE_BYTES = 1 << 18
ID_BITS = 20

#: Fixed value: how byte-level BPE splits a text before merging.
BYTE_LEVEL_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LONG_BLANK = re.compile(r"\s{1000}")


class Vocabulary:
    """Token ids of texts, and the bytes, byte lengths and decimal digits of every id."""

    def __init__(self, encode, token_bytes: list[bytes]):
        if len(token_bytes) > 1 << ID_BITS:
            raise ValueError(f"a vocabulary may have {1 << ID_BITS} ids at most")
        self.encode, self.bytes = encode, token_bytes
        self.length = np.array([len(t) for t in token_bytes], np.int64)

    def ids(self, texts: list[str], wanted: list[bytes]) -> list[list[int] | None]:
        """Ids of every text; None where their bytes are not the ``wanted`` ones."""
        spell = self.bytes.__getitem__
        return [ids if b"".join(map(spell, ids)) == raw else None
                for ids, raw in zip(self.encode(texts), wanted)]


@functools.cache
def byte_level(path: str) -> Vocabulary:
    """Byte-level BPE from a tokenizer file; reads " " + text, special tokens are plain text."""
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path)
    full.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    shown = _shown_bytes()
    ranks = {bytes(shown[c] for c in token): i for token, i in model["vocab"].items() if all(c in shown for c in token)}
    special = {i for token, i in full.get_vocab().items() if i not in model["vocab"].values()}
    table = [b""] * (max([*ranks.values(), *special]) + 1)
    for token, i in ranks.items():
        table[i] = token
    # Where ids follow the order of merges, ranks alone say how to merge. Special tokens have no rank.
    ranks = {t: i for t, i in ranks.items() if i not in special and i < 256 + len(model["merges"])}
    fast = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        spaced = [" " + t for t in texts]
        return [full.encode(t, add_special_tokens=False).ids if _LONG_BLANK.search(t)  # too deep for the other
                else fast.encode_ordinary(t) for t in spaced]

    return Vocabulary(encode, table)


def _shown_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where printable."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


@functools.cache
def pieces(path: str) -> Vocabulary:
    """Piece model with byte fallback; adds the leading space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            table.append(bytes([int(piece[3:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            table.append(b"")
        else:
            table.append(piece.replace("▁", " ").encode())
    return Vocabulary(lambda texts: model.encode(texts, num_threads=1), table)


def _digits(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimal digits of 0..n-1, each with room for a separator: bytes, starts, lengths."""
    text = [b"%d," % i for i in range(n)]
    size = np.array([len(t) for t in text], np.int64)
    return np.frombuffer(b"".join(text), np.uint8), np.cumsum(size) - size, size


class Aligned:
    """Alignment of the token ids of some documents; ``a`` and ``b`` spell the same bytes in each."""

    def __init__(self, ids_a: list[list[int]], ids_b: list[list[int]], a: Vocabulary, b: Vocabulary):
        self.n_a = np.array([len(x) for x in ids_a], np.int64)
        self.n_b = np.array([len(x) for x in ids_b], np.int64)
        self.a = np.concatenate([np.array(x, np.int64) for x in ids_a])
        self.b = np.concatenate([np.array(x, np.int64) for x in ids_b])
        self.end_a, self.end_b = np.cumsum(a.length[self.a]), np.cumsum(b.length[self.b])
        last = self.end_a[np.cumsum(self.n_a) - 1]
        # Any two neighbouring cuts of either tokenizer bound the bytes that one linked pair shares.
        both = np.sort(np.concatenate([self.end_a, self.end_b]), kind="stable")
        again = both[1:] == both[:-1]
        self.common = both[1:][again]
        cuts = both[np.append(True, ~again)]
        self.doc = np.searchsorted(last, cuts)
        self.pair = (self.a[np.searchsorted(self.end_a, cuts)] << ID_BITS) | self.b[np.searchsorted(self.end_b, cuts)]
        self.n_links = np.bincount(self.doc, minlength=len(last))
        self.n_groups = np.bincount(np.searchsorted(last, self.common), minlength=len(last))

    def group_texts(self, digits) -> list[bytes]:
        """For each document ``a1,a2|b1;a3|b2,b3``."""
        group_a, group_b = np.searchsorted(self.common, self.end_a), np.searchsorted(self.common, self.end_b)
        place_a = np.arange(len(self.a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(self.b)) + np.searchsorted(group_a, group_b, "right")
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        ids[place_a], ids[place_b] = self.a, self.b
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[place_a[np.append(group_a[1:] != group_a[:-1], True)]] = ord("|")
        mark[place_b[np.append(group_b[1:] != group_b[:-1], True)]] = ord(";")
        data, start, size = digits
        size = size[ids]
        end = np.cumsum(size)
        out = data[np.repeat(start[ids] - end + size, size) + np.arange(end[-1])]
        out[end - 1] = mark
        stop = end[np.cumsum(self.n_a + self.n_b) - 1]
        return [out[i:j - 1].tobytes() for i, j in zip(np.append(0, stop[:-1]), stop)]


# Bitmaps -------------------------------------------------------------------------------------------

def _firsts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions ``first[i], first[i] + 1, ...``, ``counts[i]`` of each."""
    return np.repeat(first - _firsts(counts), counts) + np.arange(counts.sum())


def containers(slots: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One bitmap for each of ``counts``: its share of ``slots`` (sorted), in the shortest of three forms.

    After a byte that names the form: gaps as bytes, slots as 16 bits, or bits up to the last slot.
    """
    first = _firsts(counts)
    gap = np.diff(slots, prepend=0)
    head = first[counts > 0]
    gap[head] = slots[head]
    widest, last = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    if len(head):
        widest[counts > 0] = np.maximum.reduceat(gap, head)
        last[counts > 0] = slots[head + counts[counts > 0] - 1]
    sizes = np.stack([np.where(widest < 256, counts, 2 * SLOTS), 2 * counts, np.where(counts > 0, last // 8 + 1, 0)])
    form = np.argmin(sizes, axis=0)
    size = 1 + sizes[form, np.arange(len(counts))]
    at = _firsts(size)
    out = np.zeros(size.sum(), np.uint8)
    out[at] = form
    in_form = np.repeat(form, counts)
    rows = form == GAPS
    out[_spread(at[rows] + 1, counts[rows])] = gap[in_form == GAPS]
    rows = form == LISTED
    out[_spread(at[rows] + 1, 2 * counts[rows])] = slots[in_form == LISTED].astype("<u2").view(np.uint8)
    for r in np.flatnonzero(form == BITS):
        bits = np.zeros((last[r] // 8 + 1) * 8, np.uint8)
        bits[slots[first[r]:first[r] + counts[r]]] = 1
        out[at[r] + 1:at[r] + size[r]] = np.packbits(bits, bitorder="little")
    offsets = np.append(at, len(out)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _raw(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all bitmaps, and the first byte, the length and the form of each."""
    if not len(bitmaps):
        return (np.zeros(0, np.uint8), *[np.zeros(0, np.int64)] * 3)
    offsets = np.frombuffer(bitmaps.buffers()[1], np.int32, len(bitmaps) + 1, bitmaps.offset * 4).astype(np.int64)
    data = np.frombuffer(bitmaps.buffers()[2], np.uint8)
    return data, offsets[:-1] + 1, np.diff(offsets) - 1, data[offsets[:-1]]


def slots_of(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and slot of every set bit, in the order of rows within each form."""
    data, first, size, form = _raw(bitmaps)
    every = np.arange(len(size))
    rows = form == GAPS
    sums = np.cumsum(data[_spread(first[rows], size[rows])], dtype=np.int64)
    before = np.append(0, sums)[_firsts(size[rows])]
    row, slot = [np.repeat(every[rows], size[rows])], [sums - np.repeat(before, size[rows])]
    rows = form == LISTED
    row.append(np.repeat(every[rows], size[rows] // 2))
    slot.append(data[_spread(first[rows], size[rows])].view("<u2"))
    for r in np.flatnonzero(form == BITS):
        found = np.flatnonzero(np.unpackbits(data[first[r]:first[r] + size[r]], bitorder="little"))
        row.append(np.full(len(found), r))
        slot.append(found)
    return np.concatenate(row), np.concatenate(slot).astype(np.int64)


def popcounts(bitmaps: pa.Array) -> np.ndarray:
    """Set bits of every bitmap."""
    data, first, size, form = _raw(bitmaps)
    out = np.where(form == LISTED, size // 2, size)
    for r in np.flatnonzero(form == BITS):
        out[r] = np.bitwise_count(data[first[r]:first[r] + size[r]]).sum()
    return out


_PLANES = pa.list_(pa.binary())


def bitmaps(row: np.ndarray, slot: np.ndarray, times: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Document bitmaps and multiplicity planes (bits of ``times - 1``) of ``n`` rows; sorted by row and slot."""
    extra = times - 1
    most = np.zeros(n, np.int64)
    np.maximum.at(most, row, extra)
    planes = np.ceil(np.log2(most + 1)).astype(np.int64)
    first = np.append(0, np.cumsum(planes))
    at, bit_slots = [], []
    for k in range(int(planes.max(initial=0))):
        on = (extra >> k & 1).astype(bool)
        at.append(first[row[on]] + k)
        bit_slots.append(slot[on])
    at = np.concatenate([*at, np.zeros(0, np.int64)])
    order = np.argsort(at, kind="stable")
    inner = containers(np.concatenate([*bit_slots, np.zeros(0, np.int64)])[order],
                       np.bincount(at, minlength=first[-1]).astype(np.int64))
    return (containers(slot, np.bincount(row, minlength=n).astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(first, pa.int32()), inner))


def _flat(planes: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All planes of a batch with the row and the bit each stands for."""
    size = np.diff(planes.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    return planes.flatten(), row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


# Parsing -------------------------------------------------------------------------------------------

class _Chunk:
    """Postings of the documents a task is reading."""

    def __init__(self, task: int):
        self.number, self.used, self.postings, self.parts, self.waiting = task << 32, 0, 0, [], 0

    def full(self, more: int) -> bool:
        return self.used + more > SLOTS or self.postings >= CHUNK

    def following(self) -> None:
        self.number, self.used, self.postings = self.number + 1, 0, 0

    def add(self, keys: np.ndarray, times: np.ndarray) -> None:
        self.parts.append((keys, times))
        self.postings += len(keys)
        self.waiting += len(keys)

    def flush(self) -> tuple | None:
        """Partial bitmaps of all id pairs met since the last call."""
        if not self.waiting:
            return None
        key = np.concatenate([k for k, _ in self.parts])
        times = np.concatenate([t for _, t in self.parts])
        self.parts, self.waiting = [], 0
        order = np.argsort(key)
        key, times = key[order], times[order]
        pair, slot = key >> 16, key & (SLOTS - 1)
        new = np.append(True, pair[1:] != pair[:-1])
        row = np.cumsum(new) - 1
        pair = pair[new]
        docs, planes = bitmaps(row, slot, times, len(pair))
        return pair >> ID_BITS, pair & ((1 << ID_BITS) - 1), docs, planes


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def parse(docs: DataFrame, path_a: str, path_b: str, text_col: str, keep: tuple[str, ...], with_groups: bool) -> DataFrame:
    """One row per document (``_slot`` not null) and the partial bitmaps of its task (``_a`` not null)."""
    docs = R.bounded(docs).select(F.struct(*keep).alias("_kept"), F.col(text_col).cast("string").alias("_text"))
    kept = docs.schema["_kept"]
    schema = T.StructType([
        T.StructField("_chunk", T.LongType()), T.StructField("_slot", T.IntegerType()),
        T.StructField("_kept", kept.dataType), *[T.StructField(c, T.LongType()) for c in _COUNTS],
        T.StructField("groups_sha256", T.StringType()), T.StructField("groups", T.StringType()),
        T.StructField("_a", T.IntegerType()), T.StructField("_b", T.IntegerType()),
        T.StructField("_docs", T.BinaryType()), T.StructField("_planes", T.ArrayType(T.BinaryType()))])
    names = schema.names

    def partial(chunk: _Chunk, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        found = chunk.flush()
        if found:
            a, b, bits, planes = found
            n = len(a)
            none = [pa.nulls(n, t) for t in (pa.int32(), kind, *[pa.int64()] * 4, pa.string(), pa.string())]
            whole = pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, chunk.number), pa.int64()), *none, pa.array(a, pa.int32()),
                 pa.array(b, pa.int32()), bits, planes], names)
            for at in range(0, n, 1 << 16):
                yield whole.slice(at, 1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(path_a), pieces(path_b)
        digits = _digits(max(len(a.bytes), len(b.bytes)))
        chunk = _Chunk(TaskContext.get().partitionId())
        kind = None
        for batch in batches:
            for piece in W.slices(batch, "_text", SLICE_BYTES):
                for at in range(0, piece.num_rows, SLOTS):
                    part = piece.slice(at, SLOTS)
                    kind = part.column("_kept").type
                    if chunk.full(part.num_rows):
                        yield from partial(chunk, kind)
                        chunk.following()
                    yield _documents(part, a, b, digits, chunk, with_groups, names)
                    if chunk.waiting >= FLUSH:
                        yield from partial(chunk, kind)
        yield from partial(chunk, kind)

    return docs.mapInArrow(run, schema)


def _documents(part: pa.RecordBatch, a: Vocabulary, b: Vocabulary, digits, chunk: _Chunk,
               with_groups: bool, names: list[str]) -> pa.RecordBatch:
    n = part.num_rows
    texts = part.column("_text").to_pylist()
    at = [i for i, t in enumerate(texts) if t]
    raw = [b" " + texts[i].encode() for i in at]
    both = zip(at, a.ids([texts[i] for i in at], raw), b.ids([texts[i] for i in at], raw))
    spelt = [(i, x, y) for i, x, y in both if x is not None and y is not None]
    counts = np.zeros((4, n), np.int64)
    sha, groups = [""] * n, [""] * n
    if spelt:
        at = np.array([i for i, _, _ in spelt])
        found = Aligned([x for _, x, _ in spelt], [y for _, _, y in spelt], a, b)
        counts[:, at] = found.n_a, found.n_b, found.n_groups, found.n_links
        for i, text in zip(at, found.group_texts(digits)):
            sha[i] = hashlib.sha256(text).hexdigest()
            if with_groups:
                groups[i] = text.decode()
        chunk.add(*np.unique(found.pair << 16 | (chunk.used + at[found.doc]), return_counts=True))
    out = [pa.array(np.full(n, chunk.number), pa.int64()), pa.array(np.arange(chunk.used, chunk.used + n), pa.int32()),
           part.column("_kept"), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()),
           pa.array(groups, pa.string()) if with_groups else pa.nulls(n, pa.string()),
           pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, _PLANES)]
    chunk.used += n
    return pa.RecordBatch.from_arrays(out, names)


# Merging, counting, returning ----------------------------------------------------------------------

_POSTING = "_a int, _b int, _chunk long, _docs binary, _planes array<binary>, _n_docs long, _n_links long"
_PARTIAL = ["_a", "_b", "_chunk", "_docs", "_planes"]


def _or_merged(table: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
    """``table`` with the partial bitmaps of each (a, b, chunk) as one, and its population counts."""
    if not new.all():
        group = np.cumsum(new) - 1
        row, slot = slots_of(table.column("_docs"))
        inner, plane_row, bit = _flat(table.column("_planes"))
        key = group[row] << 16 | slot
        order = np.argsort(key, kind="stable")
        key = key[order]
        times = np.ones(len(key), np.int64)
        at, plane_slot = slots_of(inner)
        np.add.at(times, np.searchsorted(key, group[plane_row[at]] << 16 | plane_slot), 1 << bit[at])
        first = np.diff(key, prepend=-1) > 0  # OR: a document of several partial bitmaps counts once
        docs, planes = bitmaps(key[first] >> 16, key[first] & (SLOTS - 1), times[first], int(group[-1]) + 1)
        head = table.filter(pa.array(new))
        table = pa.RecordBatch.from_arrays([*[head.column(c) for c in _PARTIAL[:3]], docs, planes], _PARTIAL)
    n_docs = popcounts(table.column("_docs"))
    inner, row, bit = _flat(table.column("_planes"))
    n_links = n_docs.copy()
    np.add.at(n_links, row, popcounts(inner) << bit)
    return pa.RecordBatch.from_arrays(
        [*table.columns, pa.array(n_docs, pa.int64()), pa.array(n_links, pa.int64())],
        [*_PARTIAL, "_n_docs", "_n_links"])


def _starts(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Whether each row differs in ``columns`` from the row before it."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for c in columns:
        v = batch.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        new = _starts(batch, _PARTIAL[:3])
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield _or_merged(batch.slice(0, last), new[:last])
        held = batch.slice(last)
    if held is not None:
        yield _or_merged(held, _starts(held, _PARTIAL[:3]))


def postings(parsed: DataFrame) -> DataFrame:
    """One row per id pair and chunk: merged bitmaps, documents and links."""
    partial = parsed.where("_a is not null").select(*_PARTIAL)
    return partial.repartition("_a", "_b", "_chunk").sortWithinPartitions(*_PARTIAL[:3]).mapInArrow(_merge, _POSTING)


def pair_counts(found: DataFrame) -> DataFrame:
    """Documents and links of every id pair, and whether none of its B id has more links."""
    pairs = R.stage(found.groupBy("_a", "_b").agg(
        F.sum("_n_docs").alias("n_docs"), F.sum("_n_links").alias("n_links")), "pairs")
    most = pairs.groupBy("_b").agg(F.max("n_links").alias("_most"))  # a row per B id: 2**20 at most
    out = pairs.join(F.broadcast(most), "_b")
    return out.select("_a", "_b", "n_docs", "n_links", (F.col("n_links") == F.col("_most")).alias("best"))


def _return(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the pair scores of every document; rows are sorted by chunk."""
    now, best, total = None, None, None

    def out() -> pa.RecordBatch:
        slot = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(slot), now), pa.int64()), pa.array(slot, pa.int32()),
             pa.array(best[slot], pa.int64()), pa.array(total[slot], pa.int64())],
            ["_chunk", "_slot", "n_best", "count_sum"])

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = np.flatnonzero(_starts(batch, ["_chunk"]))
        for i, j in zip(starts, [*starts[1:], batch.num_rows]):
            part = batch.slice(i, j - i)
            if part.column("_chunk")[0].as_py() != now:
                if now is not None:
                    yield out()
                now = part.column("_chunk")[0].as_py()
                best, total = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
            count, win = part.column("n_links").to_numpy(), part.column("best").to_numpy(zero_copy_only=False)
            row, slot = slots_of(part.column("_docs"))
            inner, plane_row, bit = _flat(part.column("_planes"))
            at, plane_slot = slots_of(inner)
            for r, s, times in ((row, slot, 1), (plane_row[at], plane_slot, 1 << bit[at])):
                np.add.at(total, s, count[r] * times)
                np.add.at(best, s, win[r] * times)
    if now is not None:
        yield out()


def document_scores(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """``n_best`` and ``count_sum`` of every document with links, by chunk and slot."""
    scored = found.select(*_PARTIAL).join(pairs.select("_a", "_b", "n_links", "best"), ["_a", "_b"])
    dealt = scored.select("_chunk", "_docs", "_planes", "n_links", "best").repartition("_chunk")
    return dealt.sortWithinPartitions("_chunk").mapInArrow(_return, "_chunk long, _slot int, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text",
                     keep_columns: tuple[str, ...] = ("doc_id",), with_groups: bool = False
                     ) -> tuple[DataFrame, DataFrame]:
    """Alignment of every document, and the table of id pairs.

    ``path_a`` is a byte-level BPE file, ``path_b`` a piece model. Documents have ``keep_columns``,
    ``n_a, n_b, n_groups, n_links``, ``n_best`` (links of a pair that has the most links of its B id, ties
    included), ``count_sum`` (corpus-wide links of the linked pairs, summed over links), ``groups_sha256``
    and, ``with_groups``, the text of all groups. Pairs have ``id_a, id_b, n_docs, n_links, best``.
    """
    parsed = R.stage(parse(docs, path_a, path_b, text_col, keep_columns, with_groups), "parsed")
    found = R.stage(postings(parsed), "postings")
    pairs = R.stage(pair_counts(found), "pair-scores")
    scores = document_scores(found, pairs)
    own = parsed.where("_slot is not null").select(
        "_chunk", "_slot", "_kept", *_COUNTS, "groups_sha256", *["groups"] * with_groups)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    out = own.join(scores, ["_chunk", "_slot"], "left").select(
        "_kept.*", *_COUNTS, *zero, "groups_sha256", *["groups"] * with_groups)
    return out, pairs.select(F.col("_a").alias("id_a"), F.col("_b").alias("id_b"), "n_docs", "n_links", "best")
