"""Work per task does not grow with the stored texts."""

import numpy as np
from pyspark.sql import functions as F

from lexalia.operators import blocks, clustering, topics, vectors
from lexalia.plans import corpus as base, ingest_queries, registry


def _folder(spark, tmp_path, docs=60):
    rows = [(i, f"słowo{i} kot pies dom {i % 3}", "en", f"src{i % 4}", 20) for i in range(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def _shuffle(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_texts_lie_in_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    folder, before = _folder(spark, tmp_path), _shuffle(spark)
    monkeypatch.setattr(base, "TASK_BYTES", 100)
    monkeypatch.setattr(base, "SHUFFLE_BYTES", 400)
    try:
        rows = base.corpus_dtm(spark, folder)
        assert rows.rdd.getNumPartitions() > 2 * before and _shuffle(spark) > before
        assert base.clean_terms(spark, folder).rdd.getNumPartitions() > 2 * before
        registry.load_all()
        counted = registry.QUERIES["term_days"](spark, folder).groupBy().sum("count").first()[0]
        assert counted == base.clean_terms(spark, folder).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(before))


def test_buckets_grow_with_the_corpus(spark, tmp_path, monkeypatch):
    folder = _folder(spark, tmp_path)
    monkeypatch.setattr(ingest_queries, "BUCKET_BYTES", 100)
    stored = ingest_queries.stored_corpus(spark, folder)
    assert stored["content"].count() == 60
    assert len({f.rsplit("_", 1)[1] for f in stored["content"].inputFiles()}) > 8


def test_share_of_a_group_moves_no_terms(spark):
    rows = [(f"g{i % 2}", f"t{i}", i) for i in range(20000)]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        share = vectors.corpus_probability(spark.createDataFrame(rows, "g string, term string, n long"), ["g"])
        assert "SortMergeJoin" not in share._jdf.queryExecution().executedPlan().toString()
        assert 1.99 < sum(r.p for r in share.collect()) < 2.01
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_document_frequencies_of_a_group_move_once(spark):
    rows = [(f"g{i % 2}", i, f"t{i // 2}", 1, 1) for i in range(20000)]
    dtm = spark.createDataFrame(rows, "g string, d int, term string, n int, copies int")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        freq = vectors.term_doc_freq(dtm, dtm.groupBy("g").agg(F.countDistinct("d").alias("n_docs")), ["g"])
        assert "SortMergeJoin" not in freq._jdf.queryExecution().executedPlan().toString()
        assert freq.count() == 20000 and freq.filter("round(exp(idf)) = 10000").count() == 20000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_pairs_carry_only_terms_that_two_documents_share(spark, monkeypatch):
    rows = [(1, i, f"own{i}_{k}", 1, 0.05) for i in range(30) for k in range(300)]
    rows += [(1, i, f"rare{i // 2}", 2, 0.5) for i in range(30)] + [(1, i, f"{i % 15}", 2, 0.01) for i in range(30)]
    unit = spark.createDataFrame(rows, "g int, d int, term string, doc_freq long, w double")
    written = {}
    cut = vectors.cut_lineage

    def seen(df, label="stage", replaces=None):
        out = cut(df, label, replaces)
        written[label] = out.count()
        return out

    monkeypatch.setattr(vectors, "cut_lineage", seen)
    got = vectors.cosine_pairs(unit, ["g"], "d", 0.2).collect()
    assert {(r.id_a, r.id_b) for r in got} == {(2 * i, 2 * i + 1) for i in range(15)}
    # Neither terms of one document are stored, nor pairs scored that share a term of little weight only.
    assert written["unit"] == 60 and written["leading"] <= 60 and written["candidates"] == 15


def test_hashed_terms_count_as_terms_do(spark):
    docs = spark.createDataFrame([(1, "kot pies kot"), (2, ""), (3, "pies dom 12")], "ID int, t string")
    plain, hashed = (sorted((r.ID, r.term is None, r.n) for r in vectors.dtm_from_text(
        docs, "t", ["ID"], marks=True, hashed=h).collect()) for h in (False, True))
    assert plain == hashed and [x for x in hashed if x[1]] == [(1, True, 1), (2, True, 1), (3, True, 1)]


def _texts(spark, docs=36):
    rng = np.random.default_rng(11)
    rows = []
    for g in ("a", "b"):
        for d in range(docs):
            words = [f"w{int(x) + 8 * (d % 3)}" for x in rng.integers(0, 12, 25)]
            rows.append((g, d, words + [f"own{g}{d}_{i}" for i in range(d % 4)] + [f"own{g}{d}_0"] * (d % 2)))
    rows.append(("b", 0, ["w1", "w2"]))  # a second row of a document
    rows.append((None, 7, ["w1"]))
    texts = spark.createDataFrame(rows, "period string, ID int, terms array<string>")
    counts = texts.select("period", "ID", F.explode("terms").alias("term")).groupBy("period", "ID", "term").agg(F.count("*").alias("n"))
    return texts.repartition(5, "period", "ID"), counts


def _clusters(rows):
    return {(r.period, r.ID): r.cluster for r in rows.collect()}


def test_clusters_of_texts_in_a_task_and_over_blocks(spark, monkeypatch):
    texts, counts = _texts(spark)
    counts = counts.dropna()
    freq = vectors.term_doc_freq(counts, vectors.document_counts(counts.select("period", "ID").distinct(), ["period"]), ["period"])
    unit = vectors.unit_length(vectors.tfidf(counts, freq, ["period"]), ["period", "ID"])
    monkeypatch.setattr(clustering, "LOCAL_CELLS", 0)
    expected = _clusters(clustering.cluster_documents(unit, ["period"], ["ID"], 4))
    assert len(expected) == 72 and len(set(expected.values())) == 4
    assert _clusters(clustering.cluster_texts(texts, ["period"], ["ID"], 5, 4)) == expected
    monkeypatch.setattr(clustering, "LOCAL_CELLS", 10**6)
    monkeypatch.setattr(clustering, "_SLICE_CELLS", 50)
    # Rounds in tasks: no similarity is written.
    monkeypatch.setattr(clustering, "_similarities", None)
    assert _clusters(clustering.cluster_texts(texts, ["period"], ["ID"], 5, 4)) == expected
    assert _clusters(clustering.cluster_documents(unit, ["period"], ["ID"], 4)) == expected


def test_leading_terms_are_those_of_all_topics(spark, monkeypatch):
    texts, counts = _texts(spark)
    monkeypatch.setattr(topics, "_SLICE_CELLS", 40)
    beta = topics.fit_topics(counts.dropna(), ["period"], ["ID"], k=3)
    expected = sorted(map(tuple, topics.top_topic_terms(beta, ["period"], 40).collect()))
    sizes = []
    cut = topics.cut_lineage

    def seen(df, label="stage", replaces=None, **how):
        out = cut(df, label, replaces, **how)
        sizes.append((label, out.count()))
        return out

    monkeypatch.setattr(topics, "cut_lineage", seen)
    found = sorted(map(tuple, topics.leading_terms(texts, ["period"], ["ID"], 5, 40, k=3).select(*beta.columns).collect()))
    assert [r[:3] for r in found] == [r[:3] for r in expected] and len(found) >= 2 * 3 * 40
    assert np.allclose([r[3] for r in found], [r[3] for r in expected], rtol=1e-9)


def test_terms_of_one_document_that_move_alike_are_one(spark):
    rows = [("g", d, ["shared", *[f"own{d}_{i}" for i in range(400)]]) for d in range(4)]
    texts = spark.createDataFrame(rows, "period string, ID int, terms array<string>").repartition(3, "period", "ID")
    found = topics.leading_terms(texts, ["period"], ["ID"], 3, 2000, k=3)
    assert found.count() == 3 * 1601 and found.groupBy("topic").agg(F.sum("beta").alias("s")).where("abs(s - 1) > 1e-9").isEmpty()
    drawn, held, test = topics._drawn(["period"], ["ID"], 3, 1, 10)
    packed = blocks.TextBlocks(texts, ["period"], ["ID"], 3, held, topics._classes(3), {
        "n": np.int32, "z": np.int8, "marks": np.int8, "mult": np.int32, "alone": np.int64, "stands": np.int32},
        code=lambda t: drawn(t) + 3 * test(t).cast("int"))
    cells = sum(len(x) // 4 for x in packed.table.toArrow()["_at"].to_pylist())
    assert cells <= 4 * 7 and packed.vocabulary() == {packed.groups.first()["_g"]: 1601}
    packed.drop()


def test_shuffles_go_with_the_stage_that_made_them(spark):
    from lexalia.session import _CLEANUP, shuffles_go
    before = spark.conf.get(_CLEANUP, None)
    with shuffles_go(spark):
        assert spark.conf.get(_CLEANUP) == "true"
    assert spark.conf.get(_CLEANUP, None) == before
