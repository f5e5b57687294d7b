"""Document-term counts, weights and similarity.

Long tables ``(keys, term, n)`` throughout; a vocabulary never has to fit on
one machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexalia.operators.pairs import pairs_sharing_key
from lexalia.operators.ranking import first_n_per_group
from lexalia.session import cut_lineage
from lexalia.sources.wordlists import stop_words


def unigrams(content: Column, words: list[str] | None = None) -> Column:
    """Words of a rebuilt document: digits blanked, stop words dropped."""
    dropped = [""] + (stop_words() if words is None else words)
    pieces = F.split(F.regexp_replace(content, "[0-9]+", " "), r"[ \t\r\n]+")
    return F.filter(pieces, lambda w: ~w.isin(dropped))


def with_bigrams(grams: Column) -> Column:
    """Words followed by neighbouring pairs joined with ``_``.

    Pairs come from the array zipped with itself, which stays linear even
    where the optimiser inlines the expression that makes ``grams``.
    """
    pairs = F.greatest(F.size(grams) - 1, F.lit(0))
    return F.concat(grams, F.zip_with(
        F.slice(grams, F.lit(1), pairs), F.slice(grams, F.lit(2), pairs),
        lambda first, second: F.concat(first, F.lit("_"), second)))


def _grams(docs: DataFrame, keys: list[str], text: str, words: list[str] | None) -> DataFrame:
    return docs.select(*keys, unigrams(F.col(text), words).alias("_g"))


def _terms(ngrams: int) -> Column:
    # Always an expression, never a bare column: exploding a bare column makes
    # Spark test its size in a filter that computes the array a second time.
    return with_bigrams(F.col("_g")) if ngrams == 2 else F.concat(F.col("_g"))


def term_arrays(docs: DataFrame, keys: list[str], text: str, ngrams: int = 2,
                words: list[str] | None = None) -> DataFrame:
    """``keys, terms``: all term occurrences of a document in one array."""
    return _grams(docs, keys, text, words).select(*keys, _terms(ngrams).alias("terms"))


def document_terms(docs: DataFrame, keys: list[str], text: str, ngrams: int = 2,
                   words: list[str] | None = None, marks: bool = False, hashed: bool = False) -> DataFrame:
    """One row per term occurrence; ``marks`` adds one with a NULL term per document.

    ``hashed`` gives 64-bit hashes in place of the terms, for results that do not show them.
    """
    terms = F.transform(_terms(ngrams), lambda t: F.xxhash64(t)) if hashed else _terms(ngrams)
    if marks:
        terms = F.concat(F.array(F.lit(None).cast("long" if hashed else "string")), terms)
    return _grams(docs, keys, text, words).select(*keys, F.explode(terms).alias("term"))


def dtm_from_text(docs: DataFrame, text_col: str, id_cols: list[str], ngrams: int = 2,
                  words: list[str] | None = None, marks: bool = False, hashed: bool = False) -> DataFrame:
    """``id_cols, term, n``: counts of words and word pairs per document.

    A document's occurrences sit in one task.  Where ``docs`` is already
    distributed by ``id_cols``, counting needs no shuffle at all.  ``marks``
    adds a row with a NULL term per document, so that documents can be counted
    without reading the texts again (``split_marks``).
    """
    terms = document_terms(docs, id_cols, text_col, ngrams, words, marks, hashed)
    return terms.groupBy(*id_cols, "term").agg(F.count("*").alias("n"))


def split_marks(dtm: DataFrame, by: list[str], copies: Column | None = None
                ) -> tuple[DataFrame, DataFrame]:
    """The counts of a table with marks, and ``by, n_docs``, the documents of each group."""
    n_docs = F.sum(F.lit(1) if copies is None else copies).alias("n_docs")
    return (dtm.filter(F.col("term").isNotNull()),
            dtm.filter(F.col("term").isNull()).groupBy(*by).agg(n_docs))


def frequencies_with_idf(docs: DataFrame, terms: str, by: list[str]) -> DataFrame:
    """``by, term, term_freq, doc_freq, idf`` of an array column; the texts are read once.

    The aggregation that counts the terms of a group counts its documents as
    well. Both sides of the join start from its one shuffle: told apart by a
    count, not by the term, they have no filter that would move below it.
    """
    freq = term_frequencies(docs, terms, by, count_rows=True)
    n_docs = freq.filter(F.col("term_freq") == 0).select(*by, F.col("doc_freq").alias("n_docs"))
    return add_idf(freq.filter(F.col("term_freq") > 0), n_docs, by)


def term_frequencies(docs: DataFrame, terms: str, by: list[str] | None = None,
                     count_rows: bool = False) -> DataFrame:
    """``term_freq`` and ``doc_freq`` of an array column in one scan and one shuffle.

    Each row contributes every occurrence, and each distinct term once more as
    a document mark; both sums are combined before the shuffle. ``count_rows``
    adds a NULL term whose ``doc_freq`` is the number of rows.
    """
    by = by or []
    seen = F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(False).alias("mark")))
    marks = F.transform(F.array_distinct(terms),
                        lambda t: F.struct(t.alias("term"), F.lit(True).alias("mark")))
    if count_rows:
        row = F.struct(F.lit(None).cast("string").alias("term"), F.lit(True).alias("mark"))
        marks = F.concat(F.array(row), marks)
    rows = (docs.select(*by, F.explode(F.concat(seen, marks)).alias("_t"))
            .select(*by, F.col("_t.term").alias("term"), F.col("_t.mark").alias("_mark")))
    return rows.groupBy(*by, "term").agg(
        F.count_if(~F.col("_mark")).alias("term_freq"),
        F.count_if(F.col("_mark")).alias("doc_freq"))


def document_counts(docs: DataFrame, by: list[str]) -> DataFrame:
    return docs.groupBy(*by).agg(F.count("*").alias("n_docs"))


def add_idf(freq: DataFrame, n_docs: DataFrame, by: list[str]) -> DataFrame:
    """Attach ``idf = ln(N / doc_freq)``; ``n_docs`` has one row per group."""
    idf = F.log(F.col("n_docs") / F.col("doc_freq"))
    if by:
        return freq.join(n_docs, by).withColumn("idf", idf).drop("n_docs")
    total = n_docs.select("n_docs").scalar()
    return freq.withColumn("n_docs", total).withColumn("idf", idf).drop("n_docs")


def term_doc_freq(dtm: DataFrame, n_docs: DataFrame, by: list[str],
                  copies: Column | None = None) -> DataFrame:
    """``by, term, term_freq, doc_freq, idf`` out of document-term counts.

    ``copies`` counts how many identical documents a row stands for.
    """
    times = F.lit(1) if copies is None else copies
    freq = dtm.groupBy("term", *by).agg(
        F.sum(F.col("n") * times).alias("term_freq"), F.sum(times).alias("doc_freq"))
    # Written, so that the join knows that a row per group is little and does not gather a group's terms.
    return add_idf(freq, cut_lineage(n_docs, "n_docs") if by else n_docs, by)


def tfidf(dtm: DataFrame, freq: DataFrame, by: list[str]) -> DataFrame:
    """``count × idf``; terms in every document weigh nothing and are dropped."""
    useful = freq.filter(F.col("idf") > 0).select(*by, "term", "doc_freq", "idf")
    # The term comes first: sorts by it are decided by their first key.
    return dtm.join(useful, ["term", *by]).withColumn("w", F.col("n") * F.col("idf"))


def unit_length(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Divide by the document's L2 norm; documents without weight drop out.

    The rows of a document meet once, in a window as long as the document, sorted by its last key first,
    which tells most apart.
    """
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*reversed(keys))))
    scaled = weights.withColumn("_norm", norm).filter(F.col("_norm") > 0)
    return scaled.withColumn("w", F.col("w") / F.col("_norm")).drop("_norm")


def collapse_copies(docs: DataFrame, by: list[str], doc: str, text: str) -> DataFrame:
    """One row per distinct text: smallest ID as its representative, and ``copies``.

    Grouping goes by a digest, combined before the shuffle, so a text that a
    third of all documents share costs one row per task.
    """
    return (docs.groupBy(*by, F.sha2(text, 256).alias("_digest"))
            .agg(F.min(doc).alias(doc), F.count("*").alias("copies"),
                 F.first(text).alias(text))
            .drop("_digest"))


def copy_groups(docs: DataFrame, by: list[str], doc: str, text: str) -> DataFrame:
    """Every document with the representative of its identical copies."""
    digest = docs.select(*by, doc, F.sha2(text, 256).alias("_digest"))
    reps = digest.groupBy(*by, "_digest").agg(
        F.min(doc).alias("rep_id"), F.count("*").alias("copies"))
    return digest.join(reps, [*by, "_digest"]).drop("_digest")


def cosine_pairs(unit: DataFrame, by: list[str], doc: str, min_sim: float,
                 block_rows: int = 2000) -> DataFrame:
    """All document pairs of a group with cosine similarity ``>= min_sim``.

    Exact.  Terms are ordered from rare to common; a pair that reaches the
    threshold must share a term inside both documents' leading part, beyond
    which the remaining weight is below the threshold.  Only leading parts are
    joined, without terms of one document; a candidate is kept when the weight
    from its first shared term onwards still allows the threshold, and so does
    what its shared leading terms give plus the most that may follow them. It
    is then scored on the whole vectors.
    """
    slack = 1e-9
    order = Window.partitionBy(doc, *reversed(by)).orderBy("doc_freq", "term")
    rare_first = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = 1.0 - F.coalesce(F.sum(F.col("w") * F.col("w")).over(rare_first), F.lit(0.0))
    whole = Window.partitionBy(doc, *reversed(by))
    short = F.when(F.col("rest") < min_sim - slack, F.col("rest"))
    # Stored with the vectors, so that the rows of a document meet once: the weight from each term on, and
    # the weight behind the leading part. Terms of one document have done their part with that.
    ranked = cut_lineage(
        unit.select(*by, doc, "term", "doc_freq", "w",
                    F.sqrt(F.greatest(rest, F.lit(0.0))).alias("rest"))
        .withColumn("tail", F.coalesce(F.max(short).over(whole), F.lit(0.0)))
        .filter(F.col("doc_freq") > 1).drop("doc_freq"), "unit")
    unit = ranked.select(*by, doc, "term", "w")
    leading = cut_lineage(
        ranked.filter(F.col("rest") >= min_sim - slack).select(*by, doc, "term", "w", "rest", "tail"), "leading")
    # Where one leading part ends, the other document may have all its weight left: at most the tail follows.
    follows = F.max(F.greatest("tail_a", "tail_b"))
    candidates = (
        pairs_sharing_key(leading, ["term", *by], doc, ["w", "rest", "tail"], block_rows)
        .groupBy(*by, "id_a", "id_b").agg(
            F.max(F.col("rest_a") * F.col("rest_b")).alias("_most"),
            (F.sum(F.col("w_a") * F.col("w_b")) + follows).alias("_bound"))
        .filter((F.col("_most") >= min_sim - slack) & (F.col("_bound") >= min_sim - slack))
        .select(*by, "id_a", "id_b")
    )
    candidates = cut_lineage(candidates, "candidates")
    wanted = candidates.select(*by, F.explode(F.array("id_a", "id_b")).alias(doc)).distinct()
    vectors = unit.join(wanted, [*by, doc], "left_semi").groupBy(*by, doc).agg(
        F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("v"))
    left = vectors.select(*by, F.col(doc).alias("id_a"), F.col("v").alias("va"))
    right = vectors.select(*by, F.col(doc).alias("id_b"), F.col("v").alias("vb"))
    product = F.map_zip_with("va", "vb", lambda _, x, y: x * y)
    dot = F.aggregate(F.map_values(product), F.lit(0.0),
                      lambda total, x: total + F.coalesce(x, F.lit(0.0)))
    return (
        candidates.join(left, [*by, "id_a"]).join(right, [*by, "id_b"])
        .select(*by, "id_a", "id_b", dot.alias("cos_sim"))
        .filter(F.col("cos_sim") >= min_sim)
        .withColumn("cos_dist", 1.0 - F.col("cos_sim"))
    )


def corpus_probability(dtm: DataFrame, by: list[str]) -> DataFrame:
    """``by, term, p``: share of each term in all occurrences of the group."""
    counts = dtm.groupBy(*by, "term").agg(F.sum("n").alias("term_freq"))
    return _share(cut_lineage(counts, "counts"), by)


def _share(counts: DataFrame, by: list[str], whole: DataFrame | None = None) -> DataFrame:
    """``p``, the share of ``term_freq`` in the total of its group, taken from ``whole`` if that is given."""
    whole = counts if whole is None else whole
    if by:
        # Written, so that the join knows that a row per group is little and does not gather a group's terms.
        totals = cut_lineage(whole.groupBy(*by).agg(F.sum("term_freq").alias("_total")), "totals")
        shared = counts.join(totals, by)
    else:
        shared = counts.withColumn("_total", whole.agg(F.sum("term_freq")).scalar())
    return shared.withColumn("p", F.col("term_freq") / F.col("_total")).drop("_total")


def cluster_lift(dtm: DataFrame, by: list[str], cluster: str) -> DataFrame:
    """``by, cluster, term, lift = p(term | cluster) − p(term)``.

    ``dtm`` carries the cluster of each document.
    """
    in_cluster = cut_lineage(
        dtm.groupBy(*by, cluster, "term").agg(F.sum("n").alias("term_freq")), "counts")
    # A term's rows, one per cluster, meet once: the whole group's share needs no join with them.
    terms = in_cluster.groupBy(*by, "term").agg(
        F.sum("term_freq").alias("_n"), F.collect_list(F.struct(cluster, "term_freq")).alias("_in"))
    overall = _share(terms.withColumnRenamed("_n", "term_freq"), by, in_cluster).select(*by, "term", F.col("p").alias("_p"), "_in")
    rows = overall.select(*by, "term", "_p", F.explode("_in").alias("_c")).select(*by, "term", "_p", "_c.*")
    return (_share(rows, [*by, cluster], in_cluster)
            .withColumn("lift", F.col("p") - F.col("_p"))
            .select(*by, cluster, "term", "lift"))


def top_lift_words(lift: DataFrame, by: list[str], cluster: str, n: int,
                   positive: bool = False, digits: int = 12) -> DataFrame:
    """The ``n`` best words per cluster with their rank; equal lifts go by term."""
    scored = lift.withColumn("lift", F.round("lift", digits))
    if positive:
        scored = scored.filter(F.col("lift") > 0)
    return first_n_per_group(scored, n, [*by, cluster], [F.desc("lift"), F.asc("term")])


def cluster_summary(lift: DataFrame, sizes: DataFrame, by: list[str], cluster: str,
                    n: int = 5) -> DataFrame:
    """``by, cluster, size, top_words``."""
    best = top_lift_words(lift, by, cluster, n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rn", "term"))),
                         lambda t: t["term"])
    words = best.groupBy(*by, cluster).agg(F.array_join(listed, ", ").alias("top_words"))
    return sizes.join(words, [*by, cluster])
