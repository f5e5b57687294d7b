"""Shapes of physical plans that matter at scale."""

import pytest

from lexalia.plans import registry

FOLDER = "/root/testdata/sf0.001"
registry.load_all()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "dtm", "term_doc_freq", "term_days", "window_texts", "window_doc_counts", "attach_authors",
    "author_match_before_after", "token_clean", "group_terms", "roster_flatten",
    "community_party_pct", "doc_metadata_join", "dates_before_term"])
def test_no_cross_or_nested_loop_join(spark, name):
    text = plan(registry.QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_counts_per_document_shuffle_only_the_texts(spark):
    text = plan(registry.QUERIES["dtm"](spark, FOLDER))
    assert text.count("Exchange") == 1 and "REPARTITION_BY_COL" in text


def test_scans_read_only_what_they_need(spark):
    text = plan(registry.QUERIES["daily_docs"](spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint>" in text
    text = plan(registry.QUERIES["term_doc_freq"](spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_term_frequencies_take_one_aggregation_shuffle(spark):
    from pyspark.sql import functions as F

    from lexalia.operators import vectors

    docs = spark.createDataFrame([("a b a",)], "t string").select(F.split("t", " ").alias("w"))
    freq = vectors.term_frequencies(docs, "w")
    assert plan(freq).count("Exchange") == 1
    assert {(r.term, r.term_freq, r.doc_freq) for r in freq.collect()} == {("a", 2, 1), ("b", 1, 1)}


def test_documents_are_counted_without_reading_texts_again(spark):
    df = registry.QUERIES["term_doc_freq"](spark, FOLDER)
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    text = plan(df).split("== Initial Plan ==")[0]
    assert text.count("FileScan parquet") == 1 and "ReusedExchange" in text
    assert "documents.parquet" not in plan(registry.QUERIES["tfidf"](spark, FOLDER))


def test_marks_count_documents_without_terms_and_copies(spark):
    from pyspark.sql import functions as F

    from lexalia.operators import vectors

    docs = spark.createDataFrame(
        [("p", 1, 2, "tree house tree"), ("p", 2, 1, "12 34"), ("q", 3, 1, "house")], "g string, d int, c long, t string")
    marked = vectors.dtm_from_text(docs, "t", ["g", "d", "c"], ngrams=1, marks=True)
    counts, n_docs = vectors.split_marks(marked, ["g"], F.col("c"))
    assert {tuple(r) for r in counts.select("d", "term", "n").collect()} == {(1, "tree", 2), (1, "house", 1), (3, "house", 1)}
    assert {tuple(r) for r in n_docs.collect()} == {("p", 3), ("q", 1)}
    arrays = vectors.term_arrays(docs, ["g"], "t", ngrams=1)
    freq = {(r.g, r.term): (r.term_freq, r.doc_freq, round(r.idf, 6))
            for r in vectors.frequencies_with_idf(arrays, "terms", ["g"]).collect()}
    assert freq == {("p", "tree"): (2, 1, 0.693147), ("p", "house"): (1, 1, 0.693147), ("q", "house"): (1, 1, 0.0)}
