"""Cross-tokenizer alignment beside plain Python."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lexalia.llm import token_alignment as TA

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog."), (2, "The quick brown fox"), (2, "The quick brown fox"),
    (3, None), (4, ""), (5, " "), (6, "naïve café 中文 \U0001F600 <|endoftext|> <s> x▁y"), (None, "the the the the the the"),
    (7, "é ﬁ ①"), (8, "a\0b"), (9, "\n\n  tabs\tand   spaces  "), (10, "x" * 300 + " " * 1200 + "\n" * 200),
    (11, "the cat " * 300), (12, "1234 5678 'll 's"), (13, "the quick brown fox <unk> <0x41>")]


def _plain(rows):
    """Counts of every document by sets of byte ranges."""
    full = Tokenizer.from_file(PATHS[0])
    full.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = {c: b for c, b in TA._shown_bytes().items()}
    names = {i: bytes(letters[c] for c in t) for t, i in full.get_vocab().items() if i != 50256}

    def spell(i):
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    def ranges(ids, of):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(of(i)), i))
            at += len(of(i))
        return out
    docs, links = [], []
    for key, text in rows:
        a = full.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(names[i] for i in a) != raw or b"".join(map(spell, b)) != raw:
            a = b = []
        ra, rb = ranges(a, names.get), ranges(b, spell)
        ends = sorted({r[1] for r in ra} & {r[1] for r in rb})
        groups, low = [], 0
        for high in ends:
            groups.append(",".join(str(i) for s, e, i in ra if low < e <= high) + "|"
                          + ",".join(str(i) for s, e, i in rb if low < e <= high))
            low = high
        text = ";".join(groups)
        j, own = 0, []
        for s, e, i in ra:
            while j < len(rb) and rb[j][1] <= s:
                j += 1
            k = j
            while k < len(rb) and rb[k][0] < e:
                own.append((i, rb[k][2]))
                k += 1
        links.append(own)
        docs.append((key, len(a), len(b), len(ends), len(own), text))
    count = Counter(p for own in links for p in own)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = Counter()
    for (key, na, nb, ng, nl, text), own in zip(docs, links):
        out[key, na, nb, ng, nl, sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own),
            hashlib.sha256(text.encode()).hexdigest() if text else "", text] += 1
    docs_of = Counter(p for own in links for p in set(own))
    pairs = {p: (docs_of[p], n, n == most[p[1]]) for p, n in count.items()}
    return out, pairs


@pytest.mark.parametrize("flush", [TA.FLUSH, 5])
def test_alignment_equals_plain_python(spark, flush, monkeypatch):
    rows = TEXTS + [(100 + i, f"the quick {w} number {i}") for i, w in enumerate(["fox", "cat", "dog"] * 10)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, _chunk string, n_docs int")
    monkeypatch.setattr(TA, "FLUSH", flush)
    monkeypatch.setattr(TA, "SLICE_BYTES", 64 if flush == 5 else TA.SLICE_BYTES)
    found, pairs = TA.align_tokenizers(docs.repartition(3), *PATHS, keep_columns=("doc_id", "_chunk"), with_groups=True)
    expected, counts = _plain(rows)
    got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups)
                  for r in found.collect())
    assert got == expected and found.columns[:2] == ["doc_id", "_chunk"]
    assert {(r.id_a, r.id_b): (r.n_docs, r.n_links, r.best) for r in pairs.collect()} == counts


def test_alignment_of_empty_table(spark):
    found, pairs = TA.align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), *PATHS)
    assert found.count() == 0 and pairs.count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_bitmaps_hold_and_merge(seed):
    rng = np.random.default_rng(seed)
    sizes = [0, 1, 7, 250, 300, 4095, 4096, 30000, 0, 3]
    slot = np.concatenate([np.sort(rng.choice(TA.SLOTS, n, replace=False)) for n in sizes])
    row = np.repeat(np.arange(len(sizes)), sizes)
    times = rng.integers(1, 9, len(slot))
    docs, planes = TA.bitmaps(row, slot, times, len(sizes))
    assert TA.popcounts(docs).tolist() == sizes
    r, s = TA.slots_of(docs)
    assert sorted(zip(r, s)) == list(zip(row, slot))
    # Halves of every row as partial bitmaps come back as one.
    half = rng.random(len(slot)) < 0.5
    parts = []
    for mask in (half, ~half):
        d, p = TA.bitmaps(row[mask], slot[mask], times[mask], len(sizes))
        parts.append(pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(sizes)), pa.int32()), pa.array([0] * len(sizes), pa.int32()),
             pa.array([5] * len(sizes), pa.int64()), d, p], TA._PARTIAL))
    table = pa.Table.from_batches(parts).sort_by("_a").combine_chunks().to_batches()
    merged = pa.Table.from_batches(list(TA._merge(b.slice(i, 3) for b in table for i in range(0, b.num_rows, 3))))
    assert merged["_n_docs"].to_pylist() == sizes
    assert merged["_n_links"].to_pylist() == [int(times[row == k].sum()) for k in range(len(sizes))]
    assert merged["_docs"].combine_chunks().to_pylist() == docs.to_pylist()
    assert merged["_planes"].combine_chunks().to_pylist() == planes.to_pylist()
