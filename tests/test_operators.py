"""Operators against hand-worked answers and brute force."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexalia.operators import aggregates as agg, network as net, people, ranking, vectors
from lexalia.operators.pairs import pairs_sharing_key
from lexalia.operators.tokens import pending_documents
from lexalia.operators.windows import join_windows, overlapping_windows, window_counts
from lexalia.sources.wordlists import stop_words, term_bounds


def test_top_n_keeps_ties(spark):
    df = spark.createDataFrame([(5,), (4,), (4,), (3,)], "w int")
    assert ranking.top_n_with_ties(df, 2, "w").count() == 3
    grouped = spark.createDataFrame([("a", 1), ("a", 1), ("a", 0), ("b", 7)], "g string, w int")
    assert ranking.top_n_with_ties(grouped, 1, "w", ["g"]).count() == 3


def test_rescale(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 1.0)], "g string, x double")
    rows = ranking.rescale_within(df, "x", ["g"], (0.5, 1.0), "y").orderBy("g", "x").collect()
    assert [r.y for r in rows] == [0.5, 0.75, 1.0, None]


def test_percent_share_rounds_half_to_even_and_keeps_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 39)], "g string, n int")
    rows = ranking.percent_share(df, "n", ["g"], "p").orderBy("n").collect()
    assert [r.p for r in rows] == [2, 98]


def test_exact_quantiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 10)], "g string, v double")
    row = agg.exact_quantiles(df, ["g"], "v", {"q": 0.9, "m": 0.5}).first()
    assert row.q == pytest.approx(7.9) and row.m == 2.5
    assert agg.exact_quantiles(df, [], "v", {"q": 0.9}).first().q == pytest.approx(7.9)


def test_exact_quantiles_on_a_hot_group(spark):
    values = [(("hot" if i % 3 else "cold"), (i * 7919) % 1000 / 10) for i in range(3000)]
    df = spark.createDataFrame(values, "g string, v double").repartition(8)
    rows = {r.g: r.q for r in agg.exact_quantiles(df, ["g"], "v", {"q": 0.37}).collect()}
    for g in rows:
        assert rows[g] == pytest.approx(np.quantile([v for k, v in values if k == g], 0.37))


def test_numbers_are_dense_and_continue(spark):
    docs = [("p", f"d{i:05d}") for i in range(900)] + [("q", f"d{i}") for i in range(3)]
    new = spark.createDataFrame(random.Random(1).sample(docs, len(docs)), "period string, DOC string")
    have = spark.createDataFrame([("p", 100)], "period string, max_id long")
    rows = agg.next_ids(new.repartition(8), have).orderBy("period", "DOC").collect()
    assert [r.ID for r in rows] == list(range(101, 1001)) + [1, 2, 3]


def test_distinct_count_with_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "x string")
    row = df.agg(agg.count_distinct(F.col("x")).alias("n"),
                 agg.count_distinct(F.col("x"), True).alias("m")).first()
    assert (row.n, row.m) == (1, 2)


def test_numbered_values_have_one_shape_at_any_size(spark):
    names = sorted(f"v{i}" for i in range(2500))
    df = spark.createDataFrame([("g", v) for v in names] + [("h", "v1")], "g string, v string")
    rows = agg.numbered_values(df, ["g"], "v", "t").collect()
    assert sorted((r.position, r.t) for r in rows if r.g == "g") == list(enumerate(names, 1))
    assert [(r.position, r.t) for r in rows if r.g == "h"] == [(1, "v1")]


def test_stop_words_of_one_language_leave_other_words_alone():
    assert not {"las", "mit"} & set(stop_words("pl"))
    assert "las" in stop_words("es") and "mit" in stop_words("de")
    assert set(stop_words("pl")) < set(stop_words())


@pytest.mark.parametrize("block", [3, 1000])
def test_pairs_of_a_hot_key(spark, block):
    items = {"hot": range(25), "two": [1, 9], "one": [4]}
    df = spark.createDataFrame([(k, i, i * 10) for k, v in items.items() for i in v],
                               "k string, id int, w int")
    rows = pairs_sharing_key(df, ["k"], "id", ["w"], block).collect()
    expected = {(k, a, b) for k, v in items.items() for a, b in itertools.combinations(sorted(v), 2)}
    assert len(rows) == len(expected)
    assert {(r.k, r.id_a, r.id_b) for r in rows} == expected
    assert all(r.w_a == r.id_a * 10 and r.w_b == r.id_b * 10 for r in rows)


@pytest.mark.parametrize("min_sim", [0.2, 0.6, 0.95])
def test_cosine_pairs_match_brute_force(spark, min_sim):
    rng = random.Random(7)
    docs = []
    for i in range(60):
        base = [f"t{int(rng.paretovariate(0.7)) % 40}" for _ in range(rng.randint(1, 12))]
        docs.append((1, i, {t: base.count(t) for t in base}))
    docs += [(1, 60 + i, dict(docs[i][2])) for i in range(5)]  # exact copies
    rows = [(g, i, t, n) for g, i, terms in docs for t, n in terms.items()]
    dtm = spark.createDataFrame(rows, "period int, ID int, term string, n int")
    n_docs = vectors.document_counts(dtm.select("period", "ID").distinct(), ["period"])
    freq = vectors.term_doc_freq(dtm, n_docs, ["period"])
    unit = vectors.unit_length(vectors.tfidf(dtm, freq, ["period"]), ["period", "ID"])
    got = {(r.id_a, r.id_b): r.cos_dist for r in vectors.cosine_pairs(
        unit, ["period"], "ID", min_sim, block_rows=4).collect()}

    df = {t: sum(t in terms for _, _, terms in docs) for _, _, terms in docs for t in terms}
    def vec(terms):
        w = {t: n * math.log(len(docs) / df[t]) for t, n in terms.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()} if norm else {}
    vecs = {i: vec(terms) for _, i, terms in docs}
    expected = {}
    for a, b in itertools.combinations(sorted(vecs), 2):
        sim = sum(x * vecs[b].get(t, 0.0) for t, x in vecs[a].items())
        if sim >= min_sim:
            expected[a, b] = 1 - sim
    assert set(got) == set(expected)
    assert all(got[k] == pytest.approx(expected[k], abs=1e-9) for k in got)


def test_copies_collapse_to_the_smallest_id(spark):
    docs = spark.createDataFrame([("p", 3, "x"), ("p", 1, "x"), ("p", 2, "y")],
                                 "period string, ID int, t string")
    rows = {(r.ID, r.copies) for r in vectors.collapse_copies(docs, ["period"], "ID", "t").collect()}
    assert rows == {(1, 2), (2, 1)}
    groups = {(r.ID, r.rep_id) for r in vectors.copy_groups(docs, ["period"], "ID", "t").collect()}
    assert groups == {(1, 1), (3, 1), (2, 2)}


def test_bigrams_bridge_removed_words(spark):
    docs = spark.createDataFrame([(1, "ala i kot 12 pies")], "id int, text string")
    terms = {r.term: r.n for r in vectors.dtm_from_text(docs, "text", ["id"], words=["i"]).collect()}
    assert terms == {"ala": 1, "kot": 1, "pies": 1, "ala_kot": 1, "kot_pies": 1}


def test_single_word_document_has_no_bigram(spark):
    docs = spark.createDataFrame([(1, "ala"), (2, "")], "id int, text string")
    assert [r.term for r in vectors.dtm_from_text(docs, "text", ["id"]).collect()] == ["ala"]


def test_overlapping_windows(spark):
    rows = overlapping_windows(term_bounds(spark)).orderBy("st").collect()
    assert [sum(r.period == p for r in rows) for p in ("1997-2001", "2001-2005", "2005-2007")] == [7, 7, 2]
    assert rows[0].et == dt.date(1998, 10, 15) and rows[6].et == dt.date(2001, 10, 18)
    assert rows[14].p_label == "2005-2007 (2005-10 - 2006-10)"
    assert (rows[15].st, rows[15].et) == (dt.date(2006, 4, 17), dt.date(2007, 9, 7))


def test_window_join_counts_bounds_and_empty_windows(spark):
    windows = overlapping_windows(term_bounds(spark))
    docs = spark.createDataFrame([(1, dt.date(1998, 10, 15)), (2, dt.date(1990, 1, 1))],
                                 "ID int, date date")
    assert join_windows(docs, windows).count() == 3  # end of one, inside one, start of one
    counts = window_counts(docs, windows)
    assert counts.count() == 16 and counts.agg(F.sum("count")).first()[0] == 3


def test_roster_duplicates(spark):
    roster = spark.createDataFrame(
        [("A B", "x", "p"), ("A B", "y", "p"), ("A B", "z", "p"), ("C D", "x", "p"), ("E", "x", "q")],
        "AUTHOR string, ugr string, period string")
    rows = people.roster_duplicates(roster).orderBy("period", "position").collect()
    assert [(r.period, r.n, r.uq, r.any_duplicates, r.position, r.member_dup) for r in rows] == [
        ("p", 4, 2, True, 1, "A B"), ("p", 4, 2, True, 2, "A B"), ("q", 1, 1, False, 0, "")]


def test_pending_documents(spark):
    docs = spark.createDataFrame([(i,) for i in range(5)], "ID int")
    done = spark.createDataFrame([(0,), (0,), (3,)], "ID int")
    assert [r.ID for r in pending_documents(docs, done, ["ID"], 2).orderBy("ID").collect()] == [1, 2]
    assert pending_documents(docs, docs, ["ID"], 2).count() == 0


def test_simplify_and_backbone(spark):
    edges = spark.createDataFrame(
        [("a", "b", 1.0), ("b", "a", 2.0), ("a", "a", 9.0), ("a", "c", 0.1)],
        "src string, dst string, weight double")
    rows = {(r.src, r.dst): r.weight for r in net.simplify_edges(edges, []).collect()}
    assert rows == {("a", "b"): 3.0, ("a", "c"): 0.1}
    star = spark.createDataFrame(
        [("h", f"l{i}", 10.0 if i == 0 else 1.0) for i in range(5)], "src string, dst string, weight double"
    ).withColumn("g", F.lit(1))
    kept = net.backbone(star, ["g"], 0.25).collect()
    assert [r.dst for r in kept] == ["l0"]


def test_edges_of_unknown_parties_are_a_group_of_their_own(spark):
    edges = spark.createDataFrame([("g", "P", "P", 1.0), ("g", "P", "Q", 2.0), ("g", "P", None, 4.0),
                                   ("g", None, None, 6.0)], "g string, party1 string, party2 string, weight double")
    row = net.edge_party_mix(edges, ["g"]).first()
    assert (row.count_0, row.count_1, row.count_na) == (1, 1, 2)
    assert (row.mw_0, row.mw_1, row.mw_na, row.sdw_0) == (1.0, 2.0, 5.0, 0.0)


def test_crosstab_does_not_lose_unlisted_values(spark):
    cells = spark.createDataFrame([("g", "P", "x", 1), ("g", "P", "y", 2)], "g string, party string, c string, n int")
    row = net.crosstab(cells, ["g"], "party", "c", ["x", "y", "z"], "n").first()
    assert (row.x, row.y, row.z) == (1, 2, 0)
    with pytest.raises(Exception, match="without a column"):
        net.crosstab(cells, ["g"], "party", "c", ["x"], "n").collect()


def test_community_words_keep_every_tie(spark):
    counts = spark.createDataFrame([("g", "m", f"w{i}", 1) for i in range(2500)],
                                   "g string, who string, lemma string, n int")
    members = spark.createDataFrame([("g", "m", 1)], "g string, who string, c int")
    rows = net.community_words(counts, members, ["g"], "who", "c").collect()
    assert {r.position for r in rows} == set(range(1, 2501)) and len({r.lemma for r in rows}) == 2500
