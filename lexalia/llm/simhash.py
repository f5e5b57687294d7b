"""SimHash near-dedup: tiled exact comparison of fingerprints with numpy.

A fingerprint has 64 bits, each the majority over the hashes of a text's word shingles. Texts whose
fingerprints differ in at most ``radius`` bits are linked; linked texts form a component.

* Equal fingerprints are one class: only distinct fingerprints are compared.
* The 64 bits are cut into ``radius + 2`` blocks. Two fingerprints within the radius agree in two
  blocks at least, so those that agree in some pair of blocks share a bucket, and no others are
  ever brought together.
* A bucket of up to ``TILE`` fingerprints is one tile. A larger one is cut into tiles by population
  count and hash; only pairs of tiles whose population counts differ by at most the radius meet.
* A tile is sorted by population count and compared exactly: exclusive-or of the array with itself
  shifted, bit counts, and an end as soon as population counts differ beyond the radius.
* A tile returns no pairs but a link from each fingerprint to the smallest one of its component
  inside the tile, so a dense group gives as many links as it has members.

Components come from alternating star contractions in Spark; the driver only compares two sums.

Defined cases: a text without words (null, empty, white space) has fingerprint zero and is linked
like any other; a null id never is a component's name unless all ids are null; repeated rows are
kept; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexalia.llm import rows as R, words as W

SHINGLE, RADIUS, SEED = 3, 2, 42
TILE = 2048
_HELD = 1 << 18
_PAIRS = 1 << 20


def _fingerprint(words: list[bytes], shingle: int) -> int:
    n = len(words)
    if not n:
        return 0
    size = min(shingle, n)
    text = b" ".join(words)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=starts[1:])
    a, b = starts[:n - size + 1].tolist(), (starts[size:] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, len(a), 1 << 15):
        h = np.fromiter((digest(text[i:j], SEED) for i, j in zip(a[lo:lo + (1 << 15)], b[lo:lo + (1 << 15)])),
                        np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(a), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``_id``, key, ``_fp`` of every document, the fingerprint as a signed 64-bit number."""
    rows = R.keyed(docs, id_col, text_col)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_text"):
                data, offsets = W.raw_bytes(part.column("_text"))
                text = W.LOWER[data].tobytes()
                found = np.array([_fingerprint(text[a:b].split(), shingle)
                                  for a, b in zip(offsets[:-1], offsets[1:])], np.uint64)
                yield pa.record_batch([*part.columns[:3], pa.array(W.signed(found), pa.int64())],
                                      ["_id", *R.KEY, "_fp"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(hashed, f"_id {kind}, _h long, _g int, _fp long")


def tiles(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``_g`` tile (or pair of tiles), ``_fp``: the fingerprints to be compared together."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned("_fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    pairs = list(itertools.combinations(range(n), 2))
    places = F.array(*[F.xxhash64(F.lit(k), block[i], block[j]) for k, (i, j) in enumerate(pairs)])
    spread = distinct.select("_fp", F.bit_count("_fp").cast("int").alias("_pc"), F.explode(places).alias("_bucket"))
    spread = R.stage(spread, "buckets")
    sizes = spread.groupBy("_bucket").agg(F.count("*").alias("_size")).where("_size > 1")
    sized = spread.join(sizes, "_bucket")
    small = sized.where(F.col("_size") <= TILE).select(F.col("_bucket").alias("_g"), "_fp", "_pc")

    large = sized.where(F.col("_size") > TILE)
    counts = large.groupBy("_bucket", "_pc").agg(F.ceil(F.count("*") / (TILE // 2)).cast("int").alias("_cuts"))
    own = (large.join(counts, ["_bucket", "_pc"])
           .withColumn("_cut", F.pmod(F.xxhash64("_fp"), "_cuts").cast("int")))
    others = counts.select("_bucket", F.col("_pc").alias("_pc2"), F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)).alias("_cut2"))
    met = own.join(others, "_bucket").where(F.abs(F.col("_pc") - F.col("_pc2")) <= radius)
    one, two = F.struct("_pc", "_cut"), F.struct(F.col("_pc2").alias("_pc"), F.col("_cut2").alias("_cut"))
    split = met.select(F.xxhash64("_bucket", F.least(one, two), F.greatest(one, two)).alias("_g"), "_fp", "_pc")
    return small.unionByName(split)


def _stars(i: np.ndarray, j: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For linked positions, each with the position of the smallest fingerprint of its component."""
    label = np.arange(len(fp))
    label = label[np.argsort(np.argsort(fp, kind="stable"), kind="stable")]  # rank of the fingerprint
    at = np.empty(len(fp), np.int64)
    at[label] = np.arange(len(fp))
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[at[label]]
        if np.array_equal(before, label):
            break
    moved = np.flatnonzero(at[label] != np.arange(len(fp)))
    return moved, at[label[moved]]


def _links(group: np.ndarray, fp: np.ndarray, pc: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the groups of rows sorted by group and population count."""
    here, left, right, held = np.arange(len(fp)), [], [], 0
    for step in range(1, len(fp)):
        here = here[here + step < len(fp)]
        there = here + step
        here = here[(group[here] == group[there]) & (pc[there] - pc[here] <= radius)]
        if not len(here):
            break
        near = here[np.bitwise_count(fp[here] ^ fp[here + step]) <= radius]
        left.append(near)
        right.append(near + step)
        held += len(near)
        if held > _PAIRS:
            a, b = _stars(np.concatenate(left), np.concatenate(right), fp)
            left, right, held = [a], [b], len(a)
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = _stars(np.concatenate(left), np.concatenate(right), fp)
    return fp[a], fp[b]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``u, v``: fingerprints of one component, enough links to hold every component together."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(group, fp, pc):
            a, b = _links(group, fp.view(np.uint64), pc, radius)
            pair = np.unique(np.column_stack([W.signed(a), W.signed(b)]), axis=0)
            return pa.record_batch([pa.array(pair[:, 0], pa.int64()), pa.array(pair[:, 1], pa.int64())], ["u", "v"])

        rest = None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("_g", "_fp", "_pc")]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            whole = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            for lo, hi in _parts(rows[0][:whole]):
                yield found(*(x[lo:hi] for x in rows))
            rest = [x[whole:] for x in rows]
        if rest is not None:
            yield found(*rest)

    dealt = tiles(distinct, radius).repartition("_g").sortWithinPartitions("_g", "_pc", "_fp")
    return dealt.mapInArrow(compare, "u long, v long").where("u != v").distinct()


def _parts(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of sorted groups into parts of about ``_HELD`` rows that hold whole groups."""
    lo = 0
    while lo < len(group):
        hi = min(lo + _HELD, len(group))
        if hi < len(group):
            hi = int(np.searchsorted(group, group[hi - 1], "right"))
        yield lo, hi
        lo = hi


def components(edges: DataFrame) -> DataFrame:
    """``_fp, _root`` of every linked vertex: the smallest vertex of its component.

    Alternates large-star and small-star steps until the edges stay as they are, which takes a
    number of rounds logarithmic in the length of the longest chain. Every round's edges are
    written to the shared folder in place of the last ones.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    edges = R.stage(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        near = near.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = R.stage(near, "edges", replaces=edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20, 0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("_fp"), F.col("v").alias("_root"))
        before = now


def classes(docs: DataFrame, radius: int, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Documents (``_id``, key, ``_fp``), and the ``_root`` (smallest fingerprint) of each fingerprint's component.

    Both are written tables, so that Spark can split a fingerprint which many documents have.
    """
    marks = R.stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = R.stage(marks.groupBy("_fp").agg(F.min("_id").alias("_low")), "classes")
    roots = components(links(distinct.select("_fp"), radius))
    named = distinct.join(roots, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))
    return marks, R.stage(named, "roots", replaces=distinct)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint`` (16 hexadecimal digits), ``component_id`` of every document."""
    marks, named = classes(docs, radius, shingle, id_col, text_col)
    lowest = named.groupBy("_root").agg(F.min("_low").alias("_component"))
    components_of = R.stage(named.join(lowest, "_root").select("_fp", "_component"), "components")
    return marks.join(components_of, "_fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_component").alias("component_id"))


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component: its smallest id, and one row of that."""
    marks, named = classes(docs, radius, shingle, id_col, text_col)
    order = F.struct(F.col("_id").isNull().alias("n"), "_id", *R.KEY)
    firsts = marks.groupBy("_fp").agg(F.min(order).alias("_first"))
    chosen = (firsts.join(named, "_fp").groupBy("_root").agg(F.min("_first").alias("_one"))
              .select("_one._h", "_one._g"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *R.key(id_col, text_col))
    return rows.join(chosen, R.KEY).dropDuplicates(R.KEY).select("_row.*")
