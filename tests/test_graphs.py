"""Centrality, communities, topics and clusters on small worked examples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexalia.operators.centrality import betweenness, closeness
from lexalia.operators.clustering import cluster_documents
from lexalia.operators.communities import find_communities, modularity
from lexalia.operators.network import both_directions
from lexalia.operators.topics import UPDATES, fit_topics, top_topic_terms, topic_steps

EDGE = "g int, src string, dst string, weight double"


def graph(spark, pairs, g=1):
    return spark.createDataFrame([(g, a, b, 1.0) for a, b in pairs], EDGE)


def scores(df, column):
    return {r.member: r[column] for r in df.collect()}


@pytest.mark.parametrize("passes", [1, 3])
def test_path_and_star(spark, passes):
    path = graph(spark, [("a", "b"), ("b", "c")])
    assert scores(betweenness(path, ["g"], passes), "betweenness") == {"a": 0, "b": 1, "c": 0}
    assert scores(closeness(path, ["g"], passes), "closeness") == pytest.approx(
        {"a": 1 / 3, "b": 1 / 2, "c": 1 / 3})
    star = graph(spark, [("h", x) for x in "wxyz"])
    assert scores(betweenness(star, ["g"], passes), "betweenness")["h"] == 6


def test_shared_shortest_paths(spark):
    square = graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")])
    assert scores(betweenness(square, ["g"]), "betweenness") == {v: 0.5 for v in "abcd"}


def test_two_triangles(spark):
    edges = graph(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"),
                          ("c", "x")])
    alone = spark.createDataFrame([(1, "a"), (1, "m"), (2, "a")], "g int, name string")
    lone = find_communities(edges, ["g"], alone)
    assert {(r.g, r.name, r.modularity_class) for r in lone.collect()} >= {(1, "m", 2), (1, "x", 3), (2, "a", 1)}
    assert lone.count() == 8
    found = find_communities(edges, ["g"])
    labels = {r.name: r.modularity_class for r in found.collect()}
    assert labels == {"a": 1, "b": 1, "c": 1, "x": 2, "y": 2, "z": 2}
    arcs = both_directions(edges, ["g"], "weight")
    v = found.select("g", F.col("name").alias("v"), F.col("modularity_class").alias("c"))
    assert modularity(arcs, v, ["g"]).first().q == pytest.approx(5 / 14)


def _plain_topics(cells, drawn, held, test, k, alpha, eta, steps, everything):
    """Term counts, document counts and log-perplexities of the same steps on whole matrices."""
    docs, terms = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
    n = np.zeros((len(docs), len(terms)))
    z, out, ask = np.zeros(n.shape, int), np.zeros(len(docs), bool), np.zeros(n.shape, bool)
    for d, t, m in cells:
        i, j = docs.index(d), terms.index(t)
        n[i, j], z[i, j], out[i], ask[i, j] = m, drawn[d, t], held[d], test[d, t]
    c = np.stack([(n * (z == i) * ~out[:, None]).sum(axis=0) for i in range(k)], axis=1)
    nd = np.repeat(n.sum(axis=1)[:, None] / k, k, axis=1)
    history = []
    for step in range(steps):
        all_in = step >= everything
        w = (c + eta) / (c.sum(axis=0) + len(terms) * eta)
        known = n if all_in else np.where(out[:, None] & ask, 0, n)
        for _ in range(UPDATES):
            p = w[None] * (nd + alpha)[:, None]
            nd = (p / p.sum(axis=2, keepdims=True) * known[..., None]).sum(axis=1)
        p = w[None] * (nd + alpha)[:, None]
        total = p.sum(axis=2)
        log = n * np.log(total / (nd + alpha).sum(axis=1)[:, None])
        trained = n * (all_in | ~out[:, None])
        c = (p / total[..., None] * trained[..., None]).sum(axis=0)
        history.append({"train": -(log * (trained > 0)).sum() / trained.sum()} | (
            {"held": -(log * (known < n)).sum() / (n - known).sum()} if not all_in else {}))
    return terms, (c + eta) / (c.sum(axis=0) + len(terms) * eta), history


def _topic_cells(spark, docs=40):
    rng = np.random.default_rng(3)
    rows = [(1, d, f"t{t % 15 + 15 * (d % 3)}", int(m)) for d in range(docs) for t, m in enumerate(rng.poisson(0.8, 15)) if m]
    rows += [(2, d, f"t{t}", 1) for d in range(3) for t in range(4)]
    return rows, spark.createDataFrame(rows, "g int, d0 int, term string, n int")


def test_topic_steps_match_whole_matrices(spark):
    rows, dtm = _topic_cells(spark)
    k, eta, alpha, seed, hold = 3, 0.1, 50 / 3, 306068, 4
    drawn, held, test = {}, {}, {}
    for r in dtm.where("g = 1").select(
            "d0", "term", F.pmod(F.xxhash64(F.lit(seed), "term", "d0"), F.lit(k)).alias("z"),
            (F.pmod(F.xxhash64(F.lit(seed + 1), "g", "d0"), F.lit(hold)) == 0).alias("held"),
            (F.pmod(F.xxhash64(F.lit(seed + 2), "term", "d0"), F.lit(2)) == 0).alias("test")).collect():
        drawn[r.d0, r.term], held[r.d0], test[r.d0, r.term] = r.z, r.held, r.test
    found = []
    for beta, now, done in topic_steps(dtm.repartition(3), ["g"], ["d0"], k, seed, alpha, eta, 1e-3, hold):
        found.append((beta, now, done))
        if done or len(found) > 200:
            break
    assert done
    # The group is told by its log-perplexities; the step at which all documents come in by the missing part.
    big = next(g for g, kind in found[0][1] if kind == "held")
    everything = next(i for i, (_, now, _) in enumerate(found) if (big, "held") not in now)
    terms, expected, history = _plain_topics(
        [r[1:] for r in rows if r[0] == 1], drawn, held, test, k, alpha, eta, len(found), everything)
    for (_, now, _), plain in zip(found, history):
        assert {kind: v for (g, kind), v in now.items() if g == big} == pytest.approx(plain, rel=1e-9)
    got = {(r.topic, r.term): r.beta for r in found[-1][0].where("g = 1").collect()}
    for j, t in enumerate(terms):
        assert [got[i + 1, t] for i in range(k)] == pytest.approx(expected[j].tolist(), rel=1e-9)


def test_topics_stand_still(spark):
    _, dtm = _topic_cells(spark)
    steps = topic_steps(dtm, ["g"], ["d0"], 3, 306068, 50 / 3, 0.1, 1e-3, 10)
    now = next(now for _, now, done in steps if done)
    _, after, done = next(steps)
    steps.close()
    assert done and all(abs(after[key] / now[key] - 1) <= 1e-3 for key in now)
    beta = fit_topics(dtm, ["g"], ["d0"], k=3)
    sums = beta.groupBy("g", "topic").agg(F.sum("beta").alias("s")).collect()
    assert len(sums) == 6 and [r.s for r in sums] == pytest.approx([1.0] * 6)
    assert top_topic_terms(beta, ["g"], 2).count() >= 2 * 6
    with pytest.raises(ArithmeticError):
        fit_topics(dtm, ["g"], ["d0"], k=3, limit=1)
    assert fit_topics(dtm.limit(0), ["g"], ["d0"]).count() == 0


def test_clusters_separate_disjoint_vocabularies(spark):
    rows = [(1, d, f"{'ab'[d % 2]}{t}", 0.5) for d in range(10) for t in range(4)]
    rows += [(2, 0, "x", 1.0)]
    unit = spark.createDataFrame(rows, "g int, ID int, term string, w double")
    found = cluster_documents(unit, ["g"], ["ID"], 2).collect()
    sides = {}
    for r in found:
        if r.g == 1:
            sides.setdefault(r.cluster, set()).add(r.ID % 2)
    assert sorted(map(tuple, sides.values())) == [(0,), (1,)]
    assert [r.cluster for r in found if r.g == 2] == [1]


def test_blocks_share_few_rows(spark, monkeypatch):
    from lexalia.operators import blocks as B
    monkeypatch.setattr(B, "BLOCK_CELLS", 20)
    rows = [(g, d, f"t{t % 7 if t < 3 else 10 * d + t}", float(d + t)) for g in (1, 2) for d in range(60) for t in range(6)]
    dtm = spark.createDataFrame(rows, "g int, ID int, term string, w double")
    found = B.Blocks(dtm, ["g"], ["ID"], {"w": (F.col("w"), np.float64)})
    packed = found.table.toArrow()
    parts = [B.Block(packed.slice(i, 1), found.kinds) for i in range(packed.num_rows)]
    found.drop()
    assert len(parts) > 10 and sum(len(p.at) for p in parts) == len(rows)
    names = {r._t: (r.g, r.term) for r in found.terms.collect()}
    docs = {r._d: (r.g, r.ID) for r in found.docs.collect()}
    assert sorted((*docs[d], names[t][1], w) for p in parts for d, t, w in zip(
        np.repeat(p.docs, p.sizes).tolist(), p.terms[p.at].tolist(), p.w.tolist())) == sorted(rows)
    places = [names[t] for p in parts for t in p.terms.tolist()]
    shared = [names[t] for p in parts for t in p.terms[:p.shared].tolist()]
    assert sorted(shared) == sorted(x for x in places if places.count(x) > 1)


def test_clusters_same_over_many_blocks(spark, monkeypatch):
    from lexalia.operators import blocks as B
    rng = np.random.default_rng(5)
    rows = []
    for g in (1, 2):
        for d in range(30):
            w = rng.random(8) + 0.1
            w /= np.sqrt((w * w).sum())
            rows += [(g, d, f"t{t}", float(x)) for t, x in zip(rng.choice(25, 8, replace=False) + 10 * (d % 3), w)]
    unit = spark.createDataFrame(rows, "g int, ID int, term string, w double")
    sides = {r.ID: (r.cluster) for r in cluster_documents(unit, ["g"], ["ID"], 4).where("g = 1").collect()}
    monkeypatch.setattr(B, "BLOCK_CELLS", 10)
    again = {r.ID: (r.cluster) for r in cluster_documents(unit, ["g"], ["ID"], 4).where("g = 1").collect()}
    assert sides == again and len(set(sides.values())) == 4
