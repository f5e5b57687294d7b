"""Tokens, term frequencies, weights and similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexalia.functions.text import clean_text, tokenise, TOKEN, is_noise, noise_pattern
from lexalia.operators import statistics as stats, vectors
from lexalia.operators.ranking import top_n_with_ties
from lexalia.operators.tokens import clean_tokens, lemmatise, rebuild_documents, token_rows
from lexalia.plans import corpus as base
from lexalia.plans.registry import query
from lexalia.session import cut_lineage
from lexalia.sources.tables import load
from lexalia.sources.wordlists import stop_words

KEYS = base.KEYS
MIN_SIM = 0.5
TOKEN_SQL = base._text(TOKEN)


# --- frequencies straight from text ----------------------------------------

def _words() -> Column:
    """Lower-cased tokens that are neither noise nor stop words."""
    lemmas = tokenise(F.lower(F.col("text")))
    keep = r"^[\p{L}\p{N}]+$"
    return F.filter(lemmas, lambda t: t.rlike(keep) & ~is_noise(t) & ~t.isin(stop_words()))


def _frequencies(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("text")
    freq = vectors.term_frequencies(docs.select(_words().alias("words")), "words")
    return vectors.add_idf(freq, docs.agg(F.count("*").alias("n_docs")), [])


_FREQ_SQL = f"""
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {TOKEN_SQL})) AS term
             FROM documents),
kept AS (SELECT * FROM tok
         WHERE regexp_matches(term, '^[\\p{{L}}\\p{{N}}]+$')
           AND NOT regexp_matches(term, {base._text(noise_pattern())})
           AND term NOT IN ({base.STOP_SQL})),
freq AS (SELECT term, count(*) AS term_freq, count(DISTINCT doc_id) AS doc_freq
         FROM kept GROUP BY term),
full_freq AS (SELECT *, round(ln((SELECT count(*) FROM documents) / doc_freq), 9) AS idf
              FROM freq)
"""


def _top_sql(weight: str) -> str:
    return (_FREQ_SQL + "SELECT term, term_freq, doc_freq, idf FROM full_freq "
            f"QUALIFY rank() OVER (ORDER BY {weight} DESC) <= 10")


@query("top_terms_tf", _top_sql("term_freq"))
def top_terms_tf(spark: SparkSession, folder: str) -> DataFrame:
    freq = _frequencies(spark, folder).withColumn("idf", F.round("idf", 9))
    return top_n_with_ties(freq, 10, "term_freq").orderBy(F.desc("term_freq"), "term")


@query("top_terms_df", _top_sql("doc_freq"))
def top_terms_df(spark: SparkSession, folder: str) -> DataFrame:
    freq = _frequencies(spark, folder).withColumn("idf", F.round("idf", 9))
    return top_n_with_ties(freq, 10, "doc_freq").orderBy(F.desc("doc_freq"), "term")


# --- tokens ----------------------------------------------------------------

@query("clean_text", f"""
SELECT 'documents' AS src, doc_id AS id, {base.clean_text_sql('text')} AS cleaned FROM documents
UNION ALL
SELECT 'pages', page_id, {base.clean_text_sql('html')} FROM pages
""")
def clean_text_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select(
        F.lit("documents").alias("src"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    pages = load(spark, folder, "pages").select(
        F.lit("pages").alias("src"), F.col("page_id").alias("id"), F.col("html").alias("t"))
    return docs.unionByName(pages).select("src", "id", clean_text(F.col("t")).alias("cleaned"))


def _dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Forms that end in ``s`` and occur without it too, mapped to the shorter form."""
    words = (load(spark, folder, "documents")
             .select(F.explode(F.array_distinct(tokenise(F.lower("text")))).alias("form"))
             .filter(F.col("form").rlike(r"^[\p{L}]+$")).distinct())
    stems = words.filter(F.col("form").endswith("s") & (F.length("form") > 3)).select(
        "form", F.expr("substr(form, 1, length(form) - 1)").alias("lemma"))
    return stems.join(words.select(F.col("form").alias("lemma")), "lemma", "left_semi")


@query("lemmatise_tokens", f"""
WITH {base.TAGGED_SQL},
words AS (SELECT DISTINCT form FROM
  (SELECT unnest(regexp_extract_all(lower(text), {TOKEN_SQL})) AS form FROM documents)
  WHERE regexp_matches(form, '^[\\p{{L}}]+$')),
dictionary AS (
  SELECT form, substr(form, 1, length(form) - 1) AS lemma FROM words
  WHERE form LIKE '%s' AND length(form) > 3
    AND substr(form, 1, length(form) - 1) IN (SELECT form FROM words)),
filled AS (
  SELECT period, "ID", pos, "ORG", "TAGGED" AS form FROM tagged
  UNION ALL
  SELECT period, "ID", NULL, '', '' FROM corpus
  WHERE "ID" NOT IN (SELECT "ID" FROM tagged))
SELECT period, "ID", pos, "ORG", coalesce(lemma, f.form) AS "TAGGED"
FROM filled f LEFT JOIN dictionary d ON f.form = d.form
""")
def lemmatise_tokens(spark: SparkSession, folder: str) -> DataFrame:
    tokens = token_rows(base.corpus(spark, folder), KEYS, "CONTENT")
    return lemmatise(tokens, _dictionary(spark, folder)).select(
        "period", "ID", "pos", "ORG", "TAGGED")


@query("token_clean", f"""
WITH {base.CLEAN_SQL} SELECT period, "ID", pos, "ORG", "TAGGED" FROM clean""")
def token_clean(spark: SparkSession, folder: str) -> DataFrame:
    return base.tagged_clean(spark, folder).select("period", "ID", "pos", "ORG", "TAGGED")


@query("distinct_terms", f"""
WITH {base.CLEAN_SQL}
SELECT count(DISTINCT "TAGGED") AS terms_all,
       (SELECT count(DISTINCT "TAGGED") FROM clean) AS terms_clean FROM tagged""")
def distinct_terms(spark: SparkSession, folder: str) -> DataFrame:
    # Cleaning looks only at the term, so distinct terms can be cleaned once.
    terms = (base.tagged(spark, folder).select("TAGGED").filter(F.col("TAGGED") != "")
             .groupBy("TAGGED").agg(F.lit(1).alias("_one")))
    kept = clean_tokens(terms).select("TAGGED", F.lit(1).alias("kept"))
    return terms.join(kept, "TAGGED", "left").agg(
        F.count("*").alias("terms_all"), F.count("kept").alias("terms_clean"))


@query("document_rebuild", f"""
WITH {base.DOCUMENTS_SQL} SELECT period, "ID", "CONTENT" FROM docs""")
def document_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    return rebuild_documents(base.tagged_clean(spark, folder), KEYS)


# --- terms over time -------------------------------------------------------

def _term_days(spark: SparkSession, folder: str) -> DataFrame:
    return stats.term_days(base.clean_terms(spark, folder, "date"))


_DAYS_SQL = f"""{base.CLEAN_SQL},
days AS (SELECT "TAGGED", date, count(*) AS "count", count(DISTINCT "ID") AS n_ids
         FROM clean GROUP BY "TAGGED", date)"""
_PEAK_SQL = """SELECT "TAGGED", max({m}) AS {n} FROM days GROUP BY "TAGGED"
QUALIFY rank() OVER (ORDER BY max({m}) DESC) <= 10"""
_VOLATILE_SQL = """
SELECT "TAGGED", (max(date) - min(date))::INTEGER AS n_days,
       round(stddev_samp("count"), 9) AS mn
FROM days GROUP BY "TAGGED" HAVING max(date) - min(date) > 100"""


@query("term_days", f'WITH {_DAYS_SQL} SELECT "TAGGED", date, "count", n_ids FROM days')
def term_days(spark: SparkSession, folder: str) -> DataFrame:
    return _term_days(spark, folder)


@query("peak_terms", f"WITH {_DAYS_SQL} " + _PEAK_SQL.format(m='"count"', n="count_mx"))
def peak_terms(spark: SparkSession, folder: str) -> DataFrame:
    return stats.peak_terms(_term_days(spark, folder), "count", 10, "count_mx")


@query("peak_doc_terms", f"WITH {_DAYS_SQL} " + _PEAK_SQL.format(m="n_ids", n="ids_mx"))
def peak_doc_terms(spark: SparkSession, folder: str) -> DataFrame:
    return stats.peak_terms(_term_days(spark, folder), "n_ids", 10, "ids_mx")


@query("volatile_terms", f"WITH {_DAYS_SQL}, v AS ({_VOLATILE_SQL}) "
       "SELECT * FROM v WHERE mn IS NOT NULL QUALIFY rank() OVER (ORDER BY mn DESC) <= 15")
def volatile_terms(spark: SparkSession, folder: str) -> DataFrame:
    return stats.volatile_terms(_term_days(spark, folder))


@query("term_series", f"WITH {_DAYS_SQL}, top AS ("
       + _PEAK_SQL.format(m='"count"', n="count_mx") + """)
SELECT "TAGGED", date, "count", n_ids FROM days
WHERE "TAGGED" IN (SELECT "TAGGED" FROM top)""")
def term_series(spark: SparkSession, folder: str) -> DataFrame:
    days = cut_lineage(_term_days(spark, folder), "days")
    return stats.term_series(days, stats.peak_terms(days, "count", 10, "count_mx"))


# --- document-term counts and weights --------------------------------------

@query("ngrams", f"""
WITH {base.GRAMS_SQL}
SELECT term, count(*) AS n FROM occurrences GROUP BY term""")
def ngrams(spark: SparkSession, folder: str) -> DataFrame:
    docs = base.clean_documents(spark, folder)
    terms = vectors.document_terms(docs, [], "CONTENT")
    return terms.groupBy("term").agg(F.count("*").alias("n"))


@query("dtm", f'WITH {base.GRAMS_SQL} SELECT period, "ID", term, n FROM dtm')
def dtm(spark: SparkSession, folder: str) -> DataFrame:
    return base.corpus_dtm(spark, folder)


_FREQ_BY_PERIOD_SQL = f"""{base.GRAMS_SQL}, {base.N_DOCS_SQL},
freq AS (SELECT period, term, sum(n)::BIGINT AS term_freq, count(*) AS doc_freq,
                ln(any_value(n_docs) / count(*)) AS idf
         FROM dtm JOIN n_docs USING (period) GROUP BY period, term)"""


def _freq_by_period(spark: SparkSession, folder: str) -> DataFrame:
    docs = base.clean_documents(spark, folder, keyed=True)
    arrays = vectors.term_arrays(docs, ["period"], "CONTENT")
    return vectors.frequencies_with_idf(arrays, "terms", ["period"])


@query("term_doc_freq", f"WITH {_FREQ_BY_PERIOD_SQL} "
       "SELECT period, term, term_freq, doc_freq, round(idf, 9) AS idf FROM freq")
def term_doc_freq(spark: SparkSession, folder: str) -> DataFrame:
    return _freq_by_period(spark, folder).select(
        "period", "term", "term_freq", "doc_freq", F.round("idf", 9).alias("idf"))


@query("corpus_prob", f"""WITH {base.GRAMS_SQL},
c AS (SELECT period, term, sum(n)::BIGINT AS term_freq FROM dtm GROUP BY period, term)
SELECT period, term, term_freq,
       round(term_freq / sum(term_freq) OVER (PARTITION BY period), 12) AS p FROM c""")
def corpus_prob(spark: SparkSession, folder: str) -> DataFrame:
    docs = base.clean_documents(spark, folder, keyed=True)
    counts = vectors.document_terms(docs, ["period"], "CONTENT").groupBy(
        "period", "term").agg(F.count("*").alias("n"))
    return vectors.corpus_probability(counts, ["period"]).withColumn("p", F.round("p", 12))


@query("tfidf", f"""WITH {_FREQ_BY_PERIOD_SQL}
SELECT period, "ID", d.term, n, round(n * idf, 9) AS w
FROM dtm d JOIN freq f USING (period, term) WHERE idf > 0""")
def tfidf(spark: SparkSession, folder: str) -> DataFrame:
    marked = cut_lineage(base.corpus_dtm(spark, folder, marks=True), "dtm")
    counts, n_docs = vectors.split_marks(marked, ["period"])
    freq = vectors.term_doc_freq(counts, n_docs, ["period"])
    weighted = vectors.tfidf(counts, freq, ["period"])
    return weighted.select("period", "ID", "term", "n", F.round("w", 9).alias("w"))


def _unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Unit TF-IDF vectors of the distinct texts of each period, over 64-bit hashes of the terms."""
    docs = base.clean_documents(spark, folder)
    single = base.by_document(vectors.collapse_copies(docs, ["period"], "ID", "CONTENT"), spark, folder)
    marked = cut_lineage(vectors.dtm_from_text(
        single, "CONTENT", ["period", "ID", "copies"], marks=True, hashed=True), "dtm")
    counts, n_docs = vectors.split_marks(marked, ["period"], F.col("copies"))
    freq = vectors.term_doc_freq(counts, n_docs, ["period"], F.col("copies"))
    return vectors.unit_length(vectors.tfidf(counts, freq, ["period"]), KEYS)


_REPS_SQL = """
reps AS (SELECT period, "CONTENT", min("ID") AS rep_id, count(*) AS copies
         FROM docs GROUP BY period, "CONTENT")"""


@query("cosine_pairs", f"""WITH {_FREQ_BY_PERIOD_SQL}, {_REPS_SQL},
w AS (SELECT d.period, d."ID", d.term, n * idf AS w
      FROM dtm d JOIN freq f USING (period, term)
      JOIN reps r ON r.period = d.period AND r.rep_id = d."ID" WHERE idf > 0),
u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY period, "ID")) AS v FROM w)
SELECT a.period, a."ID" AS id_a, b."ID" AS id_b, round(1 - sum(a.v * b.v), 9) AS cos_dist
FROM u a JOIN u b ON a.period = b.period AND a.term = b.term AND a."ID" < b."ID"
GROUP BY a.period, a."ID", b."ID" HAVING sum(a.v * b.v) >= {MIN_SIM}""")
def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = vectors.cosine_pairs(_unit_vectors(spark, folder), ["period"], "ID", MIN_SIM)
    return pairs.select("period", "id_a", "id_b", F.round("cos_dist", 9).alias("cos_dist"))


@query("cosine_copies", f"""WITH {base.DOCUMENTS_SQL}, {_REPS_SQL}
SELECT d.period, d."ID", r.rep_id, r.copies
FROM docs d JOIN reps r ON d.period = r.period AND d."CONTENT" = r."CONTENT" """)
def cosine_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Identical documents (distance 0) and the one that stands for them in the pairs."""
    docs = base.clean_documents(spark, folder)
    return vectors.copy_groups(docs, ["period"], "ID", "CONTENT")


# --- clusters given by labels ----------------------------------------------

def _labelled_dtm(spark: SparkSession, folder: str) -> DataFrame:
    labels = load(spark, folder, "labels").select(
        F.col("doc_id").alias("ID"),
        (F.col("quality") * 2 + F.col("toxic")).cast("long").alias("cluster"))
    docs = base.by_document(base.clean_documents(spark, folder).join(labels, "ID"), spark, folder)
    return vectors.dtm_from_text(docs, "CONTENT", ["period", "ID", "cluster"])


_LABELLED_SQL = f"""{base.GRAMS_SQL},
ldtm AS (SELECT d.period, d."ID", (quality * 2 + toxic)::BIGINT AS cluster, term, n
         FROM dtm d JOIN labels l ON l.doc_id = d."ID"),
inside AS (SELECT cluster, term, sum(n)::BIGINT AS tf FROM ldtm GROUP BY cluster, term),
whole AS (SELECT term, sum(tf) / sum(sum(tf)) OVER () AS p FROM inside GROUP BY term),
lift AS (SELECT cluster, i.term,
                round(tf / sum(tf) OVER (PARTITION BY cluster) - p, 12) AS lift
         FROM inside i JOIN whole w ON i.term = w.term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY lift DESC, term)::INTEGER
           AS rn FROM lift)"""


@query("cluster_lift", f"""WITH {_LABELLED_SQL},
sizes AS (SELECT cluster, count(DISTINCT "ID") AS size FROM ldtm GROUP BY cluster)
SELECT cluster, any_value(size) AS size, string_agg(term, ', ' ORDER BY rn) AS top_words
FROM ranked JOIN sizes USING (cluster) WHERE rn <= 5 GROUP BY cluster""")
def cluster_lift(spark: SparkSession, folder: str) -> DataFrame:
    counts = cut_lineage(_labelled_dtm(spark, folder), "dtm")
    sizes = counts.groupBy("cluster").agg(F.countDistinct("ID").alias("size"))
    lift = vectors.cluster_lift(counts, [], "cluster")
    return vectors.cluster_summary(lift, sizes, [], "cluster")


@query("cluster_words50", f"""WITH {_LABELLED_SQL},
positive AS (SELECT cluster, term, lift, row_number() OVER
  (PARTITION BY cluster ORDER BY lift DESC, term)::INTEGER AS rn FROM lift WHERE lift > 0)
SELECT cluster, term, lift, rn FROM positive WHERE rn <= 50""")
def cluster_words50(spark: SparkSession, folder: str) -> DataFrame:
    lift = vectors.cluster_lift(_labelled_dtm(spark, folder), [], "cluster")
    return vectors.top_lift_words(lift, [], "cluster", 50, positive=True).select(
        "cluster", "term", "lift", "rn")
