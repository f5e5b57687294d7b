"""Whitening beside numpy's eigenvectors; archives written, indexed and read back."""

import base64
import gzip
import hashlib
import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from lexalia.llm import queries, warc_archive as WA, whitening as H

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("case", ["full", "low rank", "equal", "clusters", "one", "none"])
def test_divide_and_conquer_finds_eigenvectors(case):
    rng = np.random.default_rng(3)
    d = 40
    x = {"full": rng.normal(size=(300, d)) * np.linspace(1, 3, d), "low rank": rng.normal(size=(300, 6)) @ rng.normal(size=(6, d)),
         "one": rng.normal(size=(9, 1)), "none": np.zeros((4, 3))}.get(case)
    v = {"equal": np.eye(d) * 2.5, "clusters": np.diag(np.repeat([4.0, 4 - 1e-9, 1.0, 0.0], 10))}.get(case)
    v = x.T @ x / len(x) if v is None else v
    values, vectors = H.eigen(v)
    top = max(np.abs(v).max(), 1)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], atol=1e-12 * top * len(v))
    assert np.allclose(vectors.T @ vectors, np.eye(len(v)), atol=1e-13)
    assert np.allclose(v @ vectors, vectors * values, atol=1e-12 * top * len(v))
    if case == "full":
        same = np.abs((vectors * np.linalg.eigh(v)[1][:, ::-1]).sum(axis=0))
        assert np.allclose(same, 1, atol=1e-12)


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(12, 12))
    a = a + a.T
    w, u = np.linalg.eigh(a)
    assert np.allclose(H.polar_factor(a), (u * np.sign(w)) @ u.T, atol=1e-13)


def _plain_whitening(rows, k):
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    lengths = Counter(len(x) for x in {tuple(x) for _, x in good})
    d = max(lengths, key=lambda n: (lengths[n], n))
    good = [(i, x) for i, x in good if len(x) == d]
    fit = np.array(sorted({tuple(x) for _, x in good}))
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return n, e, [(i, sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s)), (np.array(x) - s / n) @ u[:, :k] / np.sqrt(e[:k]))
                  for i, x in good]


def test_whitening(spark):
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(60, 6)) * np.array([3, 2, 1.5, 1, 0.5, 0.2])).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(100, base[0])] * 5 + [
        (None, base[1]), (101, None), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [math.nan] * 6), (104, [math.inf] + [0.0] * 5),
        (105, [1.0, 2.0]), (106, []), (107, [-0.0] * 6)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n int").repartition(3)
    n, e, expected = _plain_whitening([r for r in rows], 4)
    got = H.whiten(table).collect()
    assert Counter((r.vec_id, r.n, r.deviation) for r in got) == Counter((i, n, dev) for i, dev, _ in expected)
    for r in got:
        whitened = next(w for i, dev, w in expected if i == r.vec_id and dev == r.deviation)
        assert np.allclose(np.abs(r.whitened), np.abs(whitened), atol=1e-9)
        assert np.allclose(r.explained, e[:4] / e.sum(), rtol=1e-10) and r.identity_error < 1e-9
    signs = {tuple(np.sign(np.array(r.whitened) * next(w for i, _, w in expected if i == r.vec_id))) for r in got}
    assert len(signs) == 1
    assert len(H.whiten(table, components=None).first().whitened) == 6


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert H.whiten(spark.createDataFrame([], kind)).count() == 0
    assert H.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    one = H.whiten(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], kind)).collect()
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in one] == [(1, 0, [0.0, 0.0], 0.0)] * 2
    flat = H.whiten(spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(9)], kind)).collect()
    assert all(r.whitened[1:] == [0.0, 0.0] and r.identity_error < 1e-9 for r in flat)
    huge = H.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e15, 1.0]), (3, [3e15, 5.0])], kind)).collect()
    assert len(huge) == 3 and all(r.deviation is None for r in huge)


def test_whitening_query(spark):
    rows = queries.op11_embedding_whitening(spark, FOLDER).collect()
    source = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    n, e, expected = _plain_whitening([(r.vec_id, [float(c) for c in r.embedding]) for r in source], 4)
    whitened = {i: (dev, w) for i, dev, w in expected}
    assert len(rows) == 4 * len(source)
    for r in rows:
        dev, w = whitened[r.vec_id]
        assert (r.n, r.deviation) == (n, dev) and abs(abs(r.whitened) - abs(w[r.component - 1])) < 1e-8
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9


PAGES = [
    (5, "http://A.example.org/x?q=1", "<p>one</p>"), (3, "http://a.example.org/x", "<p>one</p>"), (9, "https://b.com/\n\t", "<p>one</p>"),
    (1, "none", None), (2, None, ""), (None, "http://b.com", "<p>one</p>"), (7, "http://a.example.org/x", "é\r\n\r\n中"),
    (7, "http://a.example.org/x", "é\r\n\r\n中"), (8, "", "big " * 50_000), (11, "http://a.example.org/x y\\\"z", "u"),
    *[(100 + i, "http://hot.net/", "same") for i in range(40)]]


def _plain_archive(rows):
    least = {}
    for i, _, html in rows:
        old = least.get(html or "", math.inf)
        least[html or ""] = min(old, math.inf if i is None else i)
    out = Counter()
    for i, url, html in rows:
        data = (html or "").encode()
        first = least[html or ""]
        kind = "response" if i == first else "revisit"
        out[i, url, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind,
            None if kind == "response" else first] += 1
    return out


@pytest.mark.parametrize("lines", [WA.BLOCK_LINES, 3])
def test_archive_round_trip(spark, lines, monkeypatch):
    monkeypatch.setattr(WA, "BLOCK_LINES", lines)
    monkeypatch.setattr(WA, "ARCHIVE_BYTES", 2000)
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, file string").repartition(3)
    archive = WA.write(pages)
    got = WA.fetch(archive, WA.look_up(archive, pages.select("url"))).collect()
    fields = Counter((r.id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    assert fields == _plain_archive(PAGES)
    html = {i: (t or "").encode() for i, _, t in PAGES}
    assert all((r.payload is None) if r.record_type == "revisit" else bytes(r.payload) == html[r.id] for r in got)
    # Chosen urls only, with one that was never captured.
    some = spark.createDataFrame([("http://hot.net/",), ("http://hot.net/",), ("http://hot.net",), (None,)], "u string")
    assert Counter(r.url for r in WA.fetch(archive, WA.look_up(archive, some), False).collect()) == {"http://hot.net/": 40, None: 1}
    # Archives are plain WARC files: one gzip member per record.
    files = sorted(Path(archive.folder.removeprefix("file://")).glob("archive/*.warc.gz"))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert text.count(b"WARC/1.1\r\n") == len(PAGES) and text.endswith(b"\r\n\r\n")
    assert len(files) > 3
    index = [gzip.decompress(Path(f"{archive.folder.removeprefix('file://')}/{r.file}").read_bytes()).decode().split("\n")[:-1]
             for r in archive.files.orderBy("first_key", "last_key").collect()]
    keys = [line.split("\t")[0].encode() for part in index for line in part]
    assert keys == sorted(keys) and len(keys) == len(PAGES) and b"net,hot)/" in keys


def test_archive_notices_damage(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", "text")], "page_id long, url string, html string")
    archive = WA.write(pages)
    place = archive.captures.first()
    file = Path(archive.folder.removeprefix("file://")) / place.file
    data = zlib.decompress(file.read_bytes(), 31).replace(b"text\r\n", b"next\r\n")
    file.write_bytes(gzip.compress(data, mtime=0))
    changed = spark.createDataFrame([(place.file, 0, file.stat().st_size)], "file string, offset long, length long")
    with pytest.raises(Exception, match="damaged record"):
        WA.fetch(archive, changed).collect()


def test_archive_of_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archive = WA.write(pages)
    assert WA.fetch(archive, WA.look_up(archive, pages.select("url"))).count() == 0


def test_archive_query(spark):
    rows = queries.op12_warc(spark, FOLDER).collect()
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    expected = Counter()
    for (i, _, *rest), n in _plain_archive([(p.page_id, p.url, p.html) for p in pages]).items():
        expected[(i, *rest)] += n
    assert Counter(map(tuple, rows)) == expected
