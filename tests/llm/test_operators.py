"""Small fixtures: brute force beside each operator, and nulls, empty tables, ties, repeats, odd columns."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lexalia.llm import (
    decontaminate, line_dedup, lm_backoff, packing, quality_classifier, quality_crf, queries, simhash,
    substring_dedup, toxicity, url_filter)
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
LONG = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, LONG), (2, "intro " + LONG + " outro"), (3, None), (4, ""), (5, " \n\t "), (6, "one two"),
    (7, "a b\nc d\ne f\ng h"), (8, "x\na b\nc d\ne f\n\ny"), (8, "x\na b\nc d\ne f\n\ny"), (None, "é È 中文 ÀB"),
    (None, LONG.replace("w59", "w0")), (9, "r s t u " * 40), (10, "word " + "z" * 200_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, DOCS)


def words(text):
    return (text or "").encode().split()


def sort(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_url_filter(spark):
    urls = ["http://a.example.org/es/x", "http://EXAMPLE.org/en/17?q", "https://x.com/fr/", "https://com/de/1",
            "http://notcom/de/", "http://org", "none", None, "http://x.net/#a", "http://x.com/de/", "http://x.com/de/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict)
           for r in url_filter.judge_urls(pages, queries.url_rules(spark)).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/17", "example.org/en/1", "block")
    assert got[2][2:] == ("com/fr/", "allow") and got[3][2:] == ("com/de/", "block")
    assert got[4][2] is None and got[5] == ("org", "", None, "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[9] == got[10] and len(got) == len(urls)
    assert url_filter.judge_urls(pages, queries.url_rules(spark).limit(0)).count() == len(urls)
    assert url_filter.judge_urls(pages.limit(0), queries.url_rules(spark)).count() == 0


def test_quality_rules(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_crf.quality_rules(docs, none).collect()
    assert len(rows) == len(TEXTS)
    expected = []
    for i, text in TEXTS:
        w = words(text)
        thrice = Counter(zip(w, w[1:], w[2:]))
        hit = {k + d for k in range(len(w) - 2) if thrice[tuple(w[k:k + 3])] > 1 for d in range(3)}
        lines, dup = set(), 0
        for line in (text or "").split("\n"):
            dup += bool(line.encode().split()) and line in lines
            lines.add(line)
        expected.append((i, len(w), sum(len(x.decode()) for x in w), 0, dup, len(hit)))
    assert sort(tuple(r)[:6] for r in rows) == sort(expected)
    assert all(not r.kept for r in rows if r.base_failed) and any(r.kept for r in rows)


def test_viterbi_and_marginals_are_exact():
    rng = np.random.default_rng(1)
    score, transition = rng.normal(size=7), rng.normal(size=(2, 2))
    first = np.array([0, 4, 4, 5, 7])
    label = quality_crf.viterbi(score, first, transition)
    p, _ = quality_crf.marginals(score, np.array([0, 4, 5, 7]), transition)
    for a, b in ((0, 4), (4, 5), (5, 7)):
        ways = {y: sum(score[a + k] * y[k] for k in range(b - a)) + sum(transition[u, v] for u, v in zip(y, y[1:]))
                for y in itertools.product((0, 1), repeat=b - a)}
        assert tuple(label[a:b]) == max(ways, key=ways.get)
        total = sum(map(math.exp, ways.values()))
        for k in range(b - a):
            assert p[a + k] == pytest.approx(sum(math.exp(s) for y, s in ways.items() if y[k]) / total)


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([("a", "W3, w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), ("b", "one-two"), ("c", None),
                                   (None, "w40 w41"), ("d", "c d")], "item_id string, text string")
    got = {(r.doc_id, r.n_words): r for r in decontaminate.contamination(docs, items).collect()}
    assert (got[1, 60].n_hit, got[1, 60].n_items, got[1, 60].contaminated) == (13, 1, True)
    assert got[6, 2].n_hit == 2 and got[7, 8].n_hit == 2 and got[3, 0].n_hit == 0
    assert decontaminate.contamination(docs, items).count() == len(TEXTS)
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


def test_substring_dedup(docs):
    where = Counter(tuple(w[k:k + 35]) for _, t in TEXTS for w in [words(t)] for k in range(len(w) - 34))
    expected = []
    for i, t in TEXTS:
        w = words(t)
        gone = {k + d for k in range(len(w) - 34) if where[tuple(w[k:k + 35])] > 1 for d in range(35)}
        expected.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    got = substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sort(map(tuple, got)) == sort(expected)
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


def _fingerprint(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k:k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    got = simhash.near_duplicates(docs).collect()
    prints = [_fingerprint(t) for _, t in TEXTS]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter(
        (i, f"{f:016x}") for (i, _), f in zip(TEXTS, prints))
    assert {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3}
    assert simhash.one_of_each(docs).count() == len({(r.component_id, r.fingerprint if r.component_id is None else "")
                                                     for r in got})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_links_and_chains(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base[:10].tolist():
        for k in range(0, 40, 2):  # a chain of two-bit steps
            x ^= (1 << k) | (1 << k + 1)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    parent = {int(f): int(f) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, f in enumerate(fps):
        for g in fps[i + 1:][np.bitwise_count(fps[i + 1:] ^ f) <= 2]:
            parent[find(int(g))] = find(int(f))
    table = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "_fp long")
    before = simhash.TILE
    for tile in (before, 8):
        simhash.TILE = tile
        roots = {r[0]: r[1] for r in simhash.components(simhash.links(table)).collect()}
        groups = Counter(roots.get(int(v), int(v)) for v in fps.view(np.int64))
        assert sorted(groups.values()) == sorted(Counter(find(int(f)) for f in fps).values())
    simhash.TILE = before


def test_pipeline_keeps_one_document_of_each_simhash_component(spark):
    rng = np.random.default_rng(6)
    rows = [(900, None), (901, " "), (902, "one two"), (903, "ONE  two")]
    for i in range(60):
        w = [f"q{x}" for x in rng.integers(0, 3000, 200)]
        rows.append((4 * i, " ".join(w)))
        for k, n in ((1, 0), (2, 1), (3, 2)):
            v = list(w)
            for at in rng.choice(200, n, replace=False):
                v[at] = f"new{at}"
            rows.append((4 * i + k, " ".join(v)))
    prints, root = {i: _fingerprint(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(prints, 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            low, high = sorted((find(i), find(j)))
            root[high] = low
    expected = {find(i) for i in root}
    assert 64 < len(expected) < 4 * 60  # some near copies are within two bits, some are not
    docs = spark.createDataFrame(rows, DOCS)
    left = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()]
    assert sorted(left) == sorted(expected)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), FOLDER).count() == 0


def test_line_dedup(docs):
    got = sort((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.line_dedup(docs).collect())
    by_id = {g[0]: g for g in got if g[0] is not None}
    assert by_id[7] == (7, 4, 0, "a b\nc d\ne f\ng h")
    assert by_id[8] == (8, 5, 3, "x\n\ny") and sum(g[0] == 8 for g in got) == 2
    assert by_id[3] == (3, 0, 0, None) and len(got) == len(TEXTS)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def _plain_line_dedup(rows):
    """Lines, lines removed and text left of every row; rows have ids of their own."""
    windows, out = {}, []
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        full = [p for p, x in enumerate(lines) if x.encode().split()]
        bare = [b" ".join([lines[p].encode().strip(b" \t\n\v\f\r")]) for p in full]
        gone = set()
        for k in range(len(full) - 2):
            if windows.setdefault(tuple(bare[k:k + 3]), (i, k)) != (i, k):
                gone |= {k, k + 1, k + 2}
        drop = {full[k] for k in gone}
        for k in gone:
            if k + 1 in gone:
                drop |= set(range(full[k] + 1, full[k + 1]))
        kept = "\n".join(x for p, x in enumerate(lines) if p not in drop)
        if lines[-1] == "" and len(lines) - 2 in drop and kept.endswith("\n"):
            kept = kept[:-1]
        out.append((i, len(full), len(gone), text if text is None else kept))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "\n".join(rng.choice(["a", "b", " b", "c  ", "", " ", "d e", f"own {i}"], rng.integers(0, 14))))
            for i in range(300)] + [(400, None), (401, ""), (402, "a\nb\nc\n" * 50), (403, "q\n\na\n\nb\nc\n")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in got) == _plain_line_dedup(rows)


def test_line_dedup_sql(spark):
    con = oracle.duck("/root/testdata/sf0.01")
    left = queries.op6_line_dedup(spark, "/root/testdata/sf0.01").toArrow()
    assert not oracle.differences(left, con.execute(queries.SQL["op6_line_dedup"]).to_arrow_table())


def test_packing(docs):
    full = Tokenizer.from_file(queries.tokenizer_path())
    rows = packing.pack(docs, queries.tokenizer_path(), 64).collect()
    found = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    expected = Counter()
    for i, t in TEXTS:
        ids = full.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            own = np.array(ids[k:k + 64], "<u4")
            expected[i, k // 64, k, len(own), zlib.crc32(own.tobytes())] += 1
    assert found == expected
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 64
    assert packing.pack(docs.limit(0), queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_reduction_is_optimal_on_small_instances(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 12, 7).tolist()
    plan = packing.plan(dict(Counter(sizes)), 12)
    used = len({s for s in plan["first"]})

    def fits(bins, rest, n):
        if not rest:
            return True
        return any(fits(bins[:k] + [b + rest[0]] + bins[k + 1:], rest[1:], n) for k, b in enumerate(bins) if b + rest[0] <= 12) \
            or len(bins) < n and fits(bins + [rest[0]], rest[1:], n)
    best = next(n for n in range(1, 9) if fits([], sorted(sizes, reverse=True), n))
    fixed, rest = packing.reduce_instance(dict(Counter(sizes)), 12)
    bound = sum(t for _, t in fixed) + (next(n for n in range(9) if fits([], sorted(Counter(rest).elements(), reverse=True), n)))
    assert bound == best and used <= best + 1


def test_quality_classifier(spark, docs):
    rows = queries.op8_quality_classifier(spark, FOLDER).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows) and len(rows) == 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.score_quality(docs, none).collect()} == {0.5}


def test_context_sums_match_plain_loops(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(quality_classifier, "_SPAN", 3)
    texts = ["the Cat sat on the mat 12", None, "", "one", "the cat, the Dog"]
    index = quality_classifier.index_vectors()
    out = np.zeros((quality_classifier.SLOTS, quality_classifier.SIZE), np.int64)
    seen = np.zeros(quality_classifier.SLOTS, np.int64)
    quality_classifier._context(pa.array(texts), index, out, seen)
    expected, count = np.zeros_like(out), np.zeros_like(seen)
    for text in texts:
        _, form, shape = quality_classifier.slots(pa.array([text], pa.string()))
        for i in range(len(form)):
            for own in (form, shape):
                count[own[i]] += 1
                for j in range(max(0, i - 2), min(len(form), i + 3)):
                    if j != i:
                        expected[own[i]] += index[form[j]] + index[shape[j]]
    assert (out == expected).all() and (seen == count).all()


def test_context_sums_of_a_word_said_very_often():
    """Sums far beyond 16 bits, of both signs, and a vector table that carries its weights."""
    import pyarrow as pa
    q, n = quality_classifier, 40_000
    out, seen = np.zeros((q.SLOTS, q.SIZE), np.int64), np.zeros(q.SLOTS, np.int64)
    index = q.index_vectors()
    q._context(pa.array(["so " * n]), q._packed(index), out, seen)
    _, form, shape = q.slots(pa.array(["so"]))
    around = (4 * n - 6) * (index[form[0]].astype(np.int64) + index[shape[0]])
    assert (out[form[0]] == around).all() and (out[shape[0]] == around).all() and seen.sum() == 2 * n
    ends = np.array([[-(1 << 15), (1 << 15) - 1, -1, 0] * (q.SIZE // 4)])
    assert (q._unpacked(q._packed(ends)) == ends).all()
    weight = np.linspace(0, 1, q.SLOTS, dtype=np.float32)
    assert (q.Model(out.astype(np.float32), weight).vectors[form[0]] == around.astype(np.float32) * weight[form[0]]).all()


def test_quality_sample_takes_one_text_of_an_id_and_vectors_cover_all(spark):
    good, bad = "calm words of some length here", "XX !! 99 XX !! 99"
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, good if i % 2 else bad) for i in ids] + [(ids[0], "other text")] * 50 + [(900, "unlabelled words")]
    rows += [(901, None), (902, ""), (903, good + " " + "z" * 300_000), (None, bad)]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, DOCS)
    model = quality_classifier.fit(docs.repartition(3), labels)
    again = quality_classifier.fit(docs.repartition(5), labels)
    assert (model.vectors == again.vectors).all() and model.temperature == again.temperature
    assert model.base == pytest.approx(sum(i % 2 for i in ids) / len(ids))
    import pyarrow as pa
    _, form, _ = quality_classifier.slots(pa.array(["unlabelled"]))
    assert np.abs(model.vectors[form]).sum() > 0
    got = {(r.doc_id, r.predicted) for r in quality_classifier.score_quality(docs, labels).collect()}
    assert {(i, i % 2) for i in ids[1:]} <= got and (None, 0) in got
    assert quality_classifier.score_quality(docs.limit(0), labels).count() == 0


def _plain_lm(train, text, scale):
    """The same model with dictionaries: base and backoff log-probability."""
    grams = [Counter(), Counter(), Counter()]
    for t in train:
        for n in range(3):
            grams[n].update(tuple(t[k:k + n + 1]) for k in range(len(t) - n))
    total, distinct = sum(grams[0].values()), len(grams[0])
    below = total + 0.5 * (distinct + 1)
    known = [grams[0]] + [{g: c for g, c in m.items() if c >= scale * total ** (2 / 3)} for m in grams[1:]]

    def p(history, w):
        if not history:
            return (grams[0][(w,)] + 0.5) / below
        own = known[len(history) - 1].get(history, 0)
        follow = {g: c for g, c in known[len(history)].items() if g[:-1] == history}
        if not own or not follow:
            return p(history[1:], w)
        mass = sum(c - 0.75 for c in follow.values()) / own
        return max(follow.get(history + (w,), 0.75) - 0.75, 0) / own + (1 - mass) * p(history[1:], w)
    base = sum(math.log10((grams[0][(w,)] + 0.5) / below) for w in text)
    return base, sum(math.log10(p(tuple(text[max(0, k - 2):k]), w)) for k, w in enumerate(text))


def test_lm_scoring(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", f"x{i}"], 30))) for i in range(30)]
    rows += [(30, None), (31, ""), (None, "the cat")]
    docs = spark.createDataFrame(rows, DOCS)
    lane, lm_backoff.LANE = lm_backoff.LANE, 7
    got = {r.doc_id: r for r in lm_backoff.score_texts(docs, word_scale=0.2, ngram_scale=0.2).collect()}
    lm_backoff.LANE = lane
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    tokens = {i: words(t) + [None] for i, t in rows}
    train = [t for i, t in tokens.items() if fold(i) != 1]
    for i, t in tokens.items():
        base, score = _plain_lm(train, t, 0.2)
        assert got[i].base_score == pytest.approx(base) and got[i].score == pytest.approx(score)
        assert got[i].n_tokens == len(t) and got[i].held_out == (fold(i) == 1)
    assert lm_backoff.score_texts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("word_scale", [lm_backoff.WORD_SCALE, 0.5])
def test_lm_keeps_ngrams_seen_twice_at_any_size(spark, word_scale):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"v{x}" for x in rng.zipf(1.3, 1500) % 5000)) for i in range(400)]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    trained = [i for i, _ in rows if fold(i) != 1]
    for i in trained[:2]:
        rows[i] = (i, rows[i][1] + " blue moon rises")
    asked = next(i for i in range(400, 500) if fold(i) == 1)
    rows.append((asked, "v1 blue moon rises moon v2 blue sky"))
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {r.doc_id: r for r in lm_backoff.score_texts(docs, word_scale=word_scale).collect()}
    train = [words(t) + [None] for i, t in rows if fold(i) != 1]
    total = sum(map(len, train))
    assert 0.0005 * total ** (2 / 3) > 2.1  # where a cutoff that rises with the corpus drops them
    base, score = _plain_lm(train, words(rows[-1][1]) + [None], 1.5 / total ** (2 / 3))
    assert got[asked].base_score == pytest.approx(base) and got[asked].score == pytest.approx(score)
    assert len(got) == len(rows)


def test_lm_scoring_over_many_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm_backoff, "BLOCK_BYTES", 200)
    monkeypatch.setattr(lm_backoff, "LANE", 16)
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["The", "cat", "sat", "on", f"x{i}"], 40))) for i in range(20)]
    rows += [rows[3], rows[3], (None, None), (None, "the cat"), (50, ""), (51, "sat on " * 2000)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS _block", "2 AS _held", "3 AS n_tokens").repartition(3)
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    tokens = [(i, words((t or "").lower()) + [None]) for i, t in rows]
    train = [t for i, t in tokens if fold(i) != 1]
    total = sum(map(len, train))
    expected = sort((i, len(t), *(round(x, 6) for x in _plain_lm(train, t, 1.5 / total ** (2 / 3)))) for i, t in tokens)
    for scale in (0.0005, 1e9):  # with states at hand, and with none
        got = lm_backoff.score_texts(docs, word_scale=scale).collect()
        assert sort((r.doc_id, r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == expected
        assert all(r.train_tokens == total for r in got)


def test_toxicity(spark):
    text = lambda i, bad: " ".join(f"t{(i * 7 + k) % 90}" for k in range(20)) + " vile" * bad
    rows = [(i, text(i, 1 + i % 6 if i % 3 == 0 else 0)) for i in range(120)] + [(200, None), (None, "vile vile vile")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all(got[i].toxic == (i % 3 == 0) for i in range(120)) and got[None].toxic and not got[200].toxic
    assert got[3].severity > got[1].severity and got[117].severity <= got[63].severity + 3
    assert all(r.severity == 0 for r in toxicity.score_toxicity(docs, labels.limit(0)).collect())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    step = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        after = f(spark, step, FOLDER)
        assert after.columns == docs.columns
        step = corpus_pipeline.stage(after, name)
    left = {r.doc_id for r in step.collect()}
    assert left < {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in packed} == left


CLASHES = ["_judged_kept", "_line_kept_text", "_measured", "kept", "n_lines", "kept_text", "_row", "_text", "_id",
           "_h", "_g", "_later", "_c0", "_set", "_fp", "_root", "component_id", "n_hit", "contaminated"]


@pytest.mark.parametrize("stage", range(5), ids=[name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, stage):
    name, step = corpus_pipeline.STAGES[stage]
    text = " ".join(f"word{i % 97}" for i in range(180))
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0),
            (None, text + " more", "en", None, 9), (None, None, None, None, None), (4, "a\nb\nc\nd", "en", "s", 7),
            (5, "x " * 60_000, "en", "s", 120_000)]
    docs = spark.createDataFrame([(*r, *[f"v{i}" for i in range(len(CLASHES))]) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"`{c}` string" for c in CLASHES))
    for table in (docs, docs.limit(0)):
        found = step(spark, table, FOLDER)
        if stage < 4:
            assert found.columns == docs.columns
            for row in found.collect():
                assert [row[c] for c in CLASHES] == [f"v{i}" for i in range(len(CLASHES))]
        else:
            assert found.count() >= table.count()


def test_quality_rules_keep_clashing_columns(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_crf.quality_rules(docs.withColumn("_measured", F.lit("m")).withColumn("_c0", F.lit("c")), none,
                                     keep_columns=("_measured", "_c0")).collect()
    assert {(r._measured, r._c0) for r in rows} == {("m", "c")} and len(rows) == len(TEXTS)
    assert quality_crf.quality_rules(docs.limit(0), none).count() == 0
