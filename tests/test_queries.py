"""Every registered query: SQL result where there is one, invariants elsewhere."""

import pytest

from lexalia.plans import registry
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
registry.load_all()


@pytest.fixture(scope="module")
def con():
    return oracle.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, con, name):
    found, _, _, _ = oracle.check(spark, con, FOLDER, name)
    assert not found


def test_every_sql_belongs_to_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_clusters_cover_documents(spark):
    rows = registry.QUERIES["clusters"](spark, FOLDER).toPandas()
    assert not rows.duplicated(["period", "ID"]).any()
    assert rows.groupby("period").cluster.nunique().max() <= 9
    assert rows.groupby("period").cluster.min().eq(1).all()


def test_communities_label_every_vertex_once(spark):
    rows = registry.QUERIES["communities"](spark, FOLDER).toPandas()
    assert len(rows) == registry.QUERIES["network_vertices"](spark, FOLDER).count()
    assert not rows.duplicated(["period", "name"]).any()


def test_table_lifecycle_keeps_all_documents(spark):
    rows = registry.QUERIES["table_lifecycle"](spark, FOLDER).toPandas()
    assert len(rows) == 200 and (rows.created_again == 0).all()
    assert rows.n_tokens.notna().all()


@pytest.mark.parametrize("name, low", [("author_topics", 0.5), ("topic_grid", 0.5), ("window_topics", 0.5)])
def test_topic_grids(spark, name, low):
    rows = registry.QUERIES[name](spark, FOLDER).toPandas()
    group = "p_label" if name == "window_topics" else "period"
    assert rows.y.min() == 1 and rows.tp2.max() <= 6 and rows.topic.between(1, 6).all()
    assert rows.al.dropna().between(low, 1.0).all() and rows.beta.between(0, 1).all()
    assert (rows.groupby([group, "topic"]).y.nunique() >= 5).all()


def test_leading_topic_terms(spark):
    rows = registry.QUERIES["lda_topics"](spark, FOLDER).toPandas()
    per_topic = rows.groupby(["period", "topic"]).beta
    assert (per_topic.count() >= 15).all() and (per_topic.sum() <= 1).all()
    assert (rows.groupby("period").topic.nunique() == 6).all()
