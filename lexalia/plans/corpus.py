"""The corpus view every query starts from, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexalia.functions.text import NOISE, TOKEN, URL
from lexalia.operators.tokens import (
    clean_lemma_array, clean_tokens, lemmatise, token_rows)
from lexalia.operators.vectors import dtm_from_text, term_arrays
from lexalia.session import at_least_partitions, stored_bytes
from lexalia.sources.tables import load
from lexalia.sources.wordlists import TERMS, date_words, salutations, stop_words

KEYS = ["period", "ID"]
#: Stored bytes of documents whose terms one task counts, whose counts meet in one shuffle partition, and that make a packed block.
TASK_BYTES, SHUFFLE_BYTES, BLOCK_BYTES = 2 << 20, 8 << 20, 6 << 20
PERIODS = [name for name, _, _ in TERMS]


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with date, period, author and party."""
    return corpus_view(load(spark, folder, "documents"))


def corpus_view(docs: DataFrame) -> DataFrame:
    date = F.date_add(F.lit("1997-10-20").cast("date"),
                      ((F.col("ID") * 37) % 3600).cast("int"))
    period = F.when(F.col("ID") % 50 == 0, "2001-2005")
    for name, _, end in TERMS:
        period = period.when(F.col("date") <= F.lit(end), name)
    src = F.regexp_extract("source", r"src(\d+)", 1).cast("int")
    clean = F.concat("lang", F.lit("/"), "source")
    return (
        docs.withColumnRenamed("doc_id", "ID").withColumn("date", date)
        .select(
            "ID", F.col("text").alias("CONTENT"), F.length("text").alias("len"),
            src.alias("src_no"), "date", period.alias("period"), clean.alias("AUTHOR_CLEAN"),
            F.when(F.col("ID") % 5 == 0, F.concat(clean, F.lit(" i Inny"))).otherwise(clean)
            .alias("AUTHOR"),
            F.when(src % 7 != 0, F.concat(F.lit("P"), (src % 5).cast("string"))).alias("party"),
            F.col("lang"))
    )


def document_parts(spark: SparkSession, folder: str, task_bytes: int) -> int:
    """Parts of about ``task_bytes`` of stored documents, or more where a shuffle has more."""
    size = stored_bytes(spark, f"{folder}/documents.parquet")
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // task_bytes))


def by_document(docs: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """``docs`` distributed by document, in so many parts that the counts of one fit in a task at any size.

    A number of parts that is given is not reduced by adaptive execution; a corpus that one task may hold
    needs none. The counts that follow are
    shuffled in parts that do not grow with the input either.
    """
    size = stored_bytes(spark, f"{folder}/documents.parquet")
    at_least_partitions(spark, -(-size // SHUFFLE_BYTES))
    if size <= TASK_BYTES:
        return docs.repartition(*KEYS)
    return docs.repartition(document_parts(spark, folder, TASK_BYTES), *KEYS)


def tagged(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """Token rows ``period, ID, pos, ORG, TAGGED`` of the whole corpus."""
    docs = corpus(spark, folder)
    return lemmatise(token_rows(docs, [*KEYS, *extra], "CONTENT"))


def tagged_clean(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    return clean_tokens(tagged(spark, folder, *extra).filter(F.col("TAGGED") != ""))


def clean_documents(spark: SparkSession, folder: str, *extra: str, keyed: bool = False
                    ) -> DataFrame:
    """Documents rebuilt from their cleaned lemmas, inside the row.

    ``keyed`` distributes the raw texts by document first.  Counts per document
    and term then need no shuffle, and the texts are several times smaller than
    the counts would be.
    """
    docs = corpus(spark, folder)
    if keyed:
        docs = by_document(docs, spark, folder)
    return _cleaned(docs, *extra)


def _cleaned(docs: DataFrame, *extra: str) -> DataFrame:
    words = clean_lemma_array(F.col("CONTENT"))
    # Exploding the words as a list of at most one array drops empty documents
    # without working the words out once more for a filter.
    filled = F.filter(F.array(words), lambda w: F.size(w) > 0)
    return docs.select(*KEYS, *extra, F.explode(filled).alias("_w")).select(
        *KEYS, *extra, F.array_join("_w", " ").alias("CONTENT"))


def clean_terms(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """``period, ID, TAGGED`` rows, distributed by document."""
    docs = by_document(corpus(spark, folder), spark, folder)
    words = clean_lemma_array(F.col("CONTENT"))
    return docs.select(*KEYS, *extra, F.explode(words).alias("TAGGED"))


def block_texts(spark: SparkSession, folder: str, windowed: bool = False) -> tuple[DataFrame, int]:
    """``period, ID, date, terms`` in parts that each make a packed block, and how many parts are asked for.

    Documents lie by date, so that those of a period or window, which have terms in common, are in few blocks.
    ``windowed`` adds ``_times``, the number of rows that have the document's key, in parts half as large, as documents
    come twice then.
    """
    task_bytes = BLOCK_BYTES // 2 if windowed else BLOCK_BYTES
    at_least_partitions(spark, -(-stored_bytes(spark, f"{folder}/documents.parquet") // SHUFFLE_BYTES))
    parts = document_parts(spark, folder, task_bytes)
    # A key has one date, so its rows stay together.
    docs, extra = corpus(spark, folder).repartitionByRange(parts, "date", *KEYS), ["date"]
    if windowed:
        docs, extra = docs.withColumn("_times", F.count("*").over(Window.partitionBy("date", *KEYS))), ["date", "_times"]
    return term_arrays(_cleaned(docs, *extra), [*KEYS, *extra], "CONTENT"), parts


def corpus_dtm(spark: SparkSession, folder: str, *extra: str, ngrams: int = 2,
               marks: bool = False) -> DataFrame:
    docs = clean_documents(spark, folder, *extra, keyed=True)
    return dtm_from_text(docs, "CONTENT", [*KEYS, *extra], ngrams, marks=marks)


# --- the same views in SQL -------------------------------------------------

def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_NOISE_SQL = _text("^(" + "|".join(NOISE.values()) + ")$")
STOP_SQL = quoted(stop_words())
BOUNDS_SQL = "bounds(period, start_date, end_date) AS (VALUES " + ", ".join(
    f"('{p}', DATE '{s}', DATE '{e}')" for p, s, e in TERMS) + ")"

CORPUS_SQL = f"""
corpus AS (
  SELECT doc_id AS "ID", text AS "CONTENT", length(text)::INTEGER AS len,
         src_no, date, lang,
         CASE WHEN doc_id % 50 = 0 THEN '2001-2005'
              {' '.join(f"WHEN date <= DATE '{e}' THEN '{p}'" for p, _, e in TERMS)}
         END AS period,
         lang || '/' || source AS "AUTHOR_CLEAN",
         CASE WHEN doc_id % 5 = 0 THEN lang || '/' || source || ' i Inny'
              ELSE lang || '/' || source END AS "AUTHOR",
         CASE WHEN src_no % 7 <> 0 THEN 'P' || (src_no % 5) END AS party
  FROM (SELECT *, regexp_extract(source, 'src(\\d+)', 1)::INTEGER AS src_no,
               (DATE '1997-10-20' + ((doc_id * 37) % 3600)::INTEGER)::DATE AS date
        FROM documents)
)"""


def clean_text_sql(column: str) -> str:
    marks = f"replace(replace({column}, '\"', ''), '#', '')"
    return f"regexp_replace({marks}, {_text(URL)}, '')"


TAGGED_SQL = f"""{CORPUS_SQL},
pieces AS (
  SELECT *, regexp_extract_all({clean_text_sql('"CONTENT"')}, {_text(TOKEN)}) AS ts
  FROM corpus
),
tagged AS (
  SELECT period, "ID", date, "AUTHOR_CLEAN", party, lang, pos, "ORG", lower("ORG") AS "TAGGED"
  FROM (SELECT period, "ID", date, "AUTHOR_CLEAN", party, lang, unnest(ts) AS "ORG",
               (generate_subscripts(ts, 1) - 1)::BIGINT AS pos FROM pieces)
)"""

CLEAN_SQL = f"""{TAGGED_SQL},
clean AS (
  SELECT * FROM tagged
  WHERE "TAGGED" NOT IN ({quoted(date_words() + stop_words() + salutations())})
    AND NOT regexp_matches("TAGGED", {_NOISE_SQL})
)"""

DOCUMENTS_SQL = f"""{CLEAN_SQL},
docs AS MATERIALIZED (
  SELECT period, "ID", any_value(date) AS date, any_value("AUTHOR_CLEAN") AS "AUTHOR_CLEAN",
         any_value(party) AS party, any_value(lang) AS lang,
         string_agg("TAGGED", ' ' ORDER BY pos) AS "CONTENT"
  FROM clean GROUP BY period, "ID"
)"""

GRAMS_SQL = f"""{DOCUMENTS_SQL},
gram_lists AS (
  SELECT period, "ID", lang, list_filter(
    regexp_split_to_array(regexp_replace("CONTENT", '[0-9]+', ' ', 'g'), '[ \\t\\r\\n]+'),
    lambda w: w <> '' AND w NOT IN ({STOP_SQL})) AS g
  FROM docs
),
grams AS (
  SELECT period, "ID", lang, unnest(g) AS w, generate_subscripts(g, 1) AS i FROM gram_lists
),
occurrences AS (
  SELECT period, "ID", lang, w AS term FROM grams
  UNION ALL
  SELECT period, "ID", lang, w || '_' || follows FROM
    (SELECT *, lead(w) OVER (PARTITION BY period, "ID" ORDER BY i) AS follows FROM grams)
  WHERE follows IS NOT NULL
),
dtm AS MATERIALIZED (
  SELECT period, "ID", any_value(lang) AS lang, term, count(*) AS n
  FROM occurrences GROUP BY period, "ID", term
)"""

N_DOCS_SQL = "n_docs AS (SELECT period, count(*) AS n_docs FROM docs GROUP BY period)"
