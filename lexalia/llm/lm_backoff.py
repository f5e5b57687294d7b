"""LM scoring: a weighted backoff automaton of smoothed n-grams.

Model. A token is a lower-cased (A-Z) word, or the end of the text. The unigram probability is
additive, ``(c + 0.5) / (N + 0.5 (V + 1))``. An n-gram (n up to ``ORDER``) that stands at least
``LEAST`` times in the training texts is in the model, at any corpus size, with absolute
discounting; what it discounts goes to the next lower order.

Automaton. Every n-gram of the model is a state. Its row holds how often it stands, and how many
n-grams of the model continue it (its arcs) and how often they stand: the failure arc to its suffix
(all but its first word) weighs what the arcs leave of its probability. A text is traversed once from
left to right. The state after a token is the longest n-gram of the model, of fewer than ``ORDER``
words, that ends there; the next token takes the state's arc if it has one, at the discounted
probability, and shares the failure arc, state after state down to the single word. numpy takes this
step for a lane of ``SCORE_LANE`` tokens at once, order by order; lanes begin ``ORDER - 1`` tokens early,
which is all that a state can hold.

Tables. Texts are written once as blocks of word numbers, which all passes read. N-grams are counted
by a buffer in the task and one shuffle; they travel by the range of their hash, as sorted hashes in
compressed byte planes. Words and pairs are counted first, and a triple is sent only if both its pairs
may be in the model. A block asks the ranges of the model for its distinct n-grams, and the answers
meet the block again for the traversal. A bitmap of ``BITMAP`` bits, of one size for any corpus, keeps
back n-grams that are surely not in the model; where it lets one through, the count or the answer
decides, so results do not depend on it. States standing so often that they are worth having at hand
(``WORD_SCALE * N ** (2 / 3)`` times and one in ``AT_HAND`` tokens, hence at most ``AT_HAND`` of each
order) are looked up in the tasks, which keeps hot n-grams out of the exchange. Words are known by
64-bit hashes, n-grams by a 64-bit hash of their history and their last word.

Defined cases: a null or empty text is the end token alone; repeated rows train as often as they
stand and are scored alike; without training rows N and V are 0 and no token is known.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexalia.llm import rows as R, words as W
from lexalia.session import drop_stage

ORDER, DISCOUNT, LEAST = 3, 0.75, 2
WORD_SCALE, AT_HAND = 0.0005, 1 << 20
FOLDS, HELD_OUT = 5, 1
LANE, SCORE_LANE, BLOCK_BYTES = 1 << 20, 1 << 17, 1 << 21
BITMAP = 27  # as a power of two: 16 MB
RANGE_BYTES = 1 << 20
_END = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_COMPRESSOR, _DECOMPRESSOR = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _packed(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return _COMPRESSOR.compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_DECOMPRESSOR.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)


def _packed_sorted(values: np.ndarray) -> bytes:
    return _packed(np.diff(values, prepend=np.uint64(0)))


def _unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data), dtype=np.uint64)


def token_blocks(keys: DataFrame) -> DataFrame:
    """``_ids, _held, _sizes, _words, _at``: texts of about ``BLOCK_BYTES`` as numbers of the block's sorted words.

    ``_sizes`` counts each text's tokens with its end; takes ``_id, _held, _text``.
    """
    size = BLOCK_BYTES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_text", size):
                words = W.Words(part.column("_text"), lower=True)
                token = np.insert(words.hash, np.cumsum(words.counts), _END)
                known, at = np.unique(token, return_inverse=True)
                whole = pa.array([0, part.num_rows], pa.int32())
                yield pa.record_batch(
                    [pa.ListArray.from_arrays(whole, part.column("_id")),
                     pa.ListArray.from_arrays(whole, part.column("_held")),
                     pa.array([_packed(words.counts + 1)]), pa.array([_packed_sorted(known)]), pa.array([_packed(at)])],
                    ["_ids", "_held", "_sizes", "_words", "_at"])

    kind = keys.schema["_id"].dataType.simpleString()
    return keys.mapInArrow(cut, f"_ids array<{kind}>, _held array<boolean>, _sizes binary, _words binary, _at binary")


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a block, the place of each in its text, and the texts' sizes."""
    sizes = _unpacked(row["_sizes"]).astype(np.int64)
    token = _unpacked_sorted(row["_words"])[_unpacked(row["_at"]).astype(np.int64)]
    return token, np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.flatnonzero(np.diff(values, prepend=~values[:1]))]


def _grouped(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, sorted; the order that sorts all; where each value begins in it, and how often it stands."""
    order = np.argsort(code)
    code = code[order]
    cuts = np.flatnonzero(np.diff(code, prepend=~code[:1]))
    return code[cuts], order, cuts, np.diff(np.append(cuts, len(code)))


def _tag(word: np.ndarray) -> np.ndarray:
    """The 40 bits of a word by which n-grams of one history differ."""
    return word >> np.uint64(24)


def _code(k: int, head: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Hash of the k-grams with these histories and last words; a word is its own hash."""
    return head if k == 1 else W.mix(W.mix(head + np.uint64(k)) * _STEP + tag)


def _lanes(token: np.ndarray, place: np.ndarray, order: int, lane: int) -> Iterator[tuple[int, int, list, np.ndarray]]:
    """Per lane: its first token, how many tokens it begins early, for each length the hashes of the
    n-grams that end at its tokens, and the tokens' places in their texts."""
    for lo in range(0, len(token), lane):
        lead = max(lo - order + 1, 0)
        grams, at = [token[lead:lo + lane]], place[lead:lo + lane]
        tag = _tag(grams[0])
        for k in range(2, order + 1):
            grams.append(_code(k, _before(grams[-1]), tag))
        yield lo, lo - lead, grams, at


def _before(values: np.ndarray) -> np.ndarray:
    """What stood at the token before."""
    return np.append(np.zeros(1, values.dtype), values[:-1])


def _marked(bitmap: np.ndarray | None, code: np.ndarray) -> np.ndarray:
    """Whether the bitmap holds the leading bits of each code."""
    if bitmap is None:
        return np.ones(len(code), bool)
    at = code >> np.uint64(64 - BITMAP)
    return bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1


def bitmap(codes: DataFrame) -> np.ndarray:
    """``2 ** BITMAP`` bits, those set that are the leading bits of a code in ``_w``."""
    at = F.shiftrightunsigned("_w", 64 - BITMAP)
    found = codes.groupBy(F.shiftright(at, 6).cast("int").alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    rows = found.toArrow()
    out = np.zeros(1 << BITMAP - 6, np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def gram_counts(blocks: DataFrame, lengths: list[int], bits: int, least: int = LEAST, pairs: np.ndarray | None = None,
                order: int = ORDER) -> DataFrame:
    """``_w, _k, _head, _c``: hash, length, history and count of each word, and of each n-gram from ``least``.

    ``bits`` is the number of leading bits of a hash that make its range; ``pairs`` is a bitmap that
    must hold both parts of an n-gram.
    """
    lane = LANE

    def sent(k: int, head: np.ndarray, tag: np.ndarray) -> pa.RecordBatch:
        code, order, at, n = _grouped(_code(k, head, tag))
        head, tag = head[order[at]], tag[order[at]]
        part = (code >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(code), np.int64)
        if k > 1:  # by range and leading bits of the history, which pack better in order; words are sorted already
            line = np.argsort((code >> np.uint64(64 - bits) << np.uint64(64 - bits)) | head >> np.uint64(bits) if bits else head)
            head, tag, n, part = head[line], tag[line], n[line], part[line]
        cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        spans = list(zip(cuts[:-1], cuts[1:]))
        return pa.record_batch(
            [pa.array(part[cuts[:-1]], pa.int32()), pa.array(np.full(len(spans), k, np.int8)),
             pa.array([_packed_sorted(head[a:b]) for a, b in spans], pa.binary()),
             pa.array([_packed(tag[a:b]) for a, b in spans], pa.binary()),
             pa.array([_packed(n[a:b]) for a, b in spans], pa.binary())], ["_range", "_k", "_heads", "_tags", "_n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {k: [] for k in lengths}, 0
        for batch in batches:
            for row in batch.to_pylist():
                token, place, sizes = _tokens(row)
                train = np.repeat(~np.array(row["_held"], bool), sizes)
                for lo, early, grams, at in _lanes(token, place, order, lane):
                    tag = _tag(grams[0])
                    mine = train[lo - early:lo - early + len(at)].copy()
                    mine[:early] = False
                    for k in lengths:
                        here = np.flatnonzero(mine & (at >= k - 1))
                        if k == 1:
                            held[k].append((grams[0][here], np.zeros(len(here), np.uint64)))
                            continue
                        if pairs is not None:
                            here = here[_marked(pairs, grams[k - 2][here - 1]) & _marked(pairs, grams[k - 2][here])]
                        held[k].append((grams[k - 2][here - 1], tag[here]))
                    size += len(at) - early
                    if size >= lane:
                        for k in lengths:
                            yield sent(k, *map(np.concatenate, zip(*held[k])))
                        held, size = {k: [] for k in lengths}, 0
        for k in lengths:
            if held[k]:
                yield sent(k, *map(np.concatenate, zip(*held[k])))

    def add_up(group: pa.Table) -> pa.Table:
        length, out = group.column("_k").to_numpy(), []
        for k in np.unique(length):
            own = group.filter(pa.array(length == k))
            head = np.concatenate([_unpacked_sorted(x) for x in own.column("_heads").to_pylist()])
            tag, n = (np.concatenate([_unpacked(x) for x in own.column(c).to_pylist()]) for c in ("_tags", "_n"))
            code, order, at, _ = _grouped(_code(k, head, tag))
            total = np.add.reduceat(n[order], at).astype(np.int64) if len(at) else np.zeros(0, np.int64)
            kept = total >= (least if k > 1 else 1)
            out.append(pa.table([pa.array(W.signed(code[kept])), pa.array(np.full(kept.sum(), k, np.int8)),
                                 pa.array(W.signed(head[order[at[kept]]])), pa.array(total[kept])], ["_w", "_k", "_head", "_c"]))
        return pa.concat_tables(out)

    rows = blocks.select("_held", "_sizes", "_words", "_at").mapInArrow(
        count, "_range int, _k byte, _heads binary, _tags binary, _n binary")
    return rows.groupBy("_range").applyInArrow(add_up, "_w long, _k byte, _head long, _c long")


def automaton(grams: DataFrame) -> DataFrame:
    """``_w, _k, _c, _arcs, _taken`` of every state: its count, the number of its arcs, and how often they stand."""
    arcs = grams.where("_k > 1").groupBy(F.col("_head").alias("_w")).agg(
        F.count("*").alias("_arcs"), F.sum("_c").alias("_taken"))
    return grams.drop("_head").join(arcs, "_w", "left").fillna(0, ["_arcs", "_taken"])


class _States:
    """Sorted hashes of states with their numbers."""

    def __init__(self, code: np.ndarray, numbers: list[np.ndarray]):
        line = np.argsort(code, kind="stable")
        self.code, self.numbers = code[line], [x[line] for x in numbers]

    def place(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted hash, -1 where missing."""
        if not len(self.code):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.code, wanted), len(self.code) - 1)
        return np.where(self.code[at] == wanted, at, -1)

    def fill(self, wanted: np.ndarray, into: list[np.ndarray]) -> None:
        at = self.place(wanted)
        hit = np.flatnonzero(at >= 0)
        for out, own in zip(into, self.numbers):
            out[hit] = own[at[hit]]


_NUMBERS = ["_c", "_arcs", "_taken"]


def _states(table: pa.Table) -> _States:
    return _States(table.column("_w").to_numpy().view(np.uint64), [table.column(c).to_numpy() for c in _NUMBERS])


def traverse(numbers: list[list[np.ndarray]], at: np.ndarray, below: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of a lane: whether it is known, its unigram and its automaton probability.

    ``numbers`` has, for each length, count, arcs and their count of the n-gram ending at each token,
    zeros where that is no state; ``at`` is the token's place in its text.
    """
    count = numbers[0][0]
    known, base = count > 0, (count + 0.5) / below
    p = base
    for k in range(1, len(numbers)):
        state, arcs, taken = map(_before, numbers[k - 1])
        own = numbers[k][0]
        inside = (at >= k) & (state > 0)
        state = np.maximum(state, 1)
        fails = 1 - (taken - DISCOUNT * arcs) / state
        p = np.where(inside, np.where(own > 0, own - DISCOUNT, 0) / state + fails * p, p)
    return known, base, p


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While a table is written, shuffle files go as soon as the write has ended; then the session's setting again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
                word_scale: float = WORD_SCALE, ngram_scale: float = 0.0, least: int = LEAST) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    ``least`` is the count from which an n-gram is in the model; a positive ``ngram_scale`` raises it
    to ``ngram_scale * N ** (2 / 3)``.
    """
    if not 1 <= order <= 3:
        raise ValueError("order must be 1, 2 or 3")
    with _shuffles_dropped(docs.sparkSession):
        return _score_texts(docs, id_col, text_col, order, word_scale, ngram_scale, least)


def _score_texts(docs: DataFrame, id_col: str, text_col: str, order: int, word_scale: float, ngram_scale: float,
                 least: int) -> DataFrame:
    keys = R.bounded(docs).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    keys = keys.select("_id", (R.crc_mod(F.col("_id"), FOLDS) == HELD_OUT).alias("_held"), "_text")
    blocks = R.stage(token_blocks(keys).select(F.monotonically_increasing_id().alias("_block"), "*"), "token-blocks")
    here = blocks.agg(F.sum(F.length("_at"))).first()[0] or 0
    bits = max(int(here / RANGE_BYTES), 1).bit_length()
    short = R.stage(gram_counts(blocks, list(range(1, min(order, 2) + 1)), bits, least, order=order), "words-and-pairs")
    total = short.where("_k = 1").agg(F.sum("_c"), F.count("*")).first()
    tokens, distinct = total[0] or 0, total[1]
    size = max(tokens, 1) ** (2 / 3)
    below = tokens + 0.5 * (distinct + 1)
    grams, triples = short, None
    if order > 2:
        pairs = bitmap(short.where("_k = 2"))
        triples = R.stage(gram_counts(blocks, [3], bits, least, pairs, order), "triples")
        grams = short.unionByName(triples)
    grams = grams.where((F.col("_k") == 1) | (F.col("_c") >= ngram_scale * size))
    table = R.stage(automaton(grams), "automaton", replaces=short)
    drop_stage(triples)
    common = F.col("_c") >= max(word_scale * size, tokens / AT_HAND)
    hand = _states(table.where(common).select("_w", *_NUMBERS).toArrow())
    held = bitmap(table.where(~common).select("_w"))
    lane, score_lane = LANE, min(LANE, SCORE_LANE)

    def asked_of(codes: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """Ranges of the model and the sorted hashes to ask for there; always the same for the same block."""
        codes = [code[_marked(held, code)] for code in codes]
        codes = [code[hand.place(code) < 0] for code in codes]
        code = np.unique(np.concatenate([np.zeros(0, np.uint64), *codes]))
        part = (code >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(part[a]), code[a:b]

    def distinct_grams(row: dict) -> list[np.ndarray]:
        """Distinct n-grams of a block, sorted, by lane and length."""
        token, place, _ = _tokens(row)
        return [_distinct(gram[early:][at[early:] >= k])
                for _, early, grams, at in _lanes(token, place, order, lane) for k, gram in enumerate(grams)]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asked = list(asked_of(distinct_grams(row)))
                yield pa.record_batch(
                    [pa.array([part for part, _ in asked], pa.int32()),
                     pa.array([row["_block"]] * len(asked), pa.int64()),
                     pa.array([_packed_sorted(code) for _, code in asked], pa.binary())], ["_range", "_block", "_codes"])

    def answer(asked: pa.Table, states: pa.Table) -> pa.Table:
        own, out = _states(states), []
        for part, block, codes in zip(*(asked.column(c).to_pylist() for c in ("_range", "_block", "_codes"))):
            code = _unpacked_sorted(codes)
            into = [np.zeros(len(code), np.int64) for _ in _NUMBERS]
            own.fill(code, into)
            out.append((part, block, _packed(np.concatenate(into))))
        columns = list(zip(*out)) or [[]] * 3
        return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()),
                         pa.array(columns[2], pa.binary())], ["_range", "_block", "_numbers"])

    def answered(grams: list[np.ndarray], answers: pa.Table) -> _States:
        """The states a block asked for, their numbers in the order of its questions."""
        asked = dict(asked_of(grams))
        code, numbers = [np.zeros(0, np.uint64)], [[np.zeros(0, np.int64)] for _ in _NUMBERS]
        for found in answers.to_pylist():
            code.append(asked[found["_range"]])
            for own, x in zip(numbers, _unpacked(found["_numbers"]).view(np.int64).reshape(len(_NUMBERS), -1)):
                own.append(x)
        return _States(np.concatenate(code), [np.concatenate(x) for x in numbers])

    def prepared(token: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        """Per lane its first token, how many tokens it begins early, places, and for each length the distinct
        n-grams (sorted, so that the search stays in cache) with the place of each token's in them."""
        for lo, early, grams, at in _lanes(token, place, order, score_lane):
            found = (np.unique(gram, return_inverse=True) for gram in grams)
            yield lo, early, at, [(code, where.astype(np.int32)) for code, where in found]

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            token, place, sizes = _tokens(row)
            kept = list(prepared(token, place)) if len(token) <= lane else None  # a longer text is prepared twice
            asked = []
            for _, early, at, found in kept or prepared(token, place):
                for k, (code, where) in enumerate(found):
                    own = np.zeros(len(code), bool)
                    own[where[early:][at[early:] >= k]] = True
                    asked.append(code[own])
            tables = [hand, answered(asked, answers)]
            del asked, found
            doc = np.repeat(np.arange(len(sizes)), sizes)
            sums = np.zeros((3, len(sizes)))
            for lo, early, at, found in kept or prepared(token, place):
                numbers = []
                for code, where in found:
                    into = [np.zeros(len(code), np.int64) for _ in _NUMBERS]
                    for table in tables:
                        table.fill(code, into)
                    numbers.append([x[where] for x in into])
                known, base, p = (x[early:] for x in traverse(numbers, at, below))
                own = doc[lo:lo + len(known)]
                for k, x in enumerate((known, np.log10(base), np.log10(p))):
                    sums[k] += np.bincount(own, x, len(sizes))
            out.append(pa.table([
                pa.array(row["_ids"], block.schema.field("_ids").type.value_type),
                pa.array(row["_held"], pa.bool_()), pa.array(sizes, pa.int64()), pa.array(sums[0].astype(np.int64)),
                pa.array(np.full(len(sizes), tokens), pa.int64()), pa.array(sums[1]), pa.array(sums[2])],
                [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out)

    asked = blocks.select("_block", "_sizes", "_words", "_at").mapInArrow(ask, "_range int, _block long, _codes binary")
    states = table.where(~common).select("_w", *_NUMBERS).withColumn(
        "_range", F.shiftrightunsigned("_w", 64 - bits).cast("int"))
    answers = asked.groupBy("_range").cogroup(states.groupBy("_range")).applyInArrow(
        answer, "_range int, _block long, _numbers binary")
    answers = R.stage(answers, "answers", replaces=table)
    kind = blocks.schema["_ids"].dataType.elementType.simpleString()
    return blocks.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(
        score, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
               "base_score double, score double")
