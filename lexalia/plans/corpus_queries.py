"""Documents: scans, dates, lengths, days and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexalia.functions.dates import (
    MONTH_PATTERN, MONTHS, YEAR_SUFFIX, date_rule_violations, parse_tail_date)
from lexalia.operators import statistics as stats
from lexalia.operators.aggregates import next_ids, null_rate
from lexalia.operators.people import apply_overrides
from lexalia.operators.ranking import moving_average
from lexalia.operators.tokens import pending_documents
from lexalia.operators.windows import join_windows, overlapping_windows, window_counts
from lexalia.plans import corpus as base
from lexalia.plans.registry import query
from lexalia.sources.tables import documents_with_metadata, load, reconcile_counts
from lexalia.sources.wordlists import term_bounds

CORPUS = base.CORPUS_SQL
BOUNDS = base.BOUNDS_SQL


# --- scans and keys --------------------------------------------------------

@query("period_scan", f"""WITH {CORPUS}
SELECT period, count(*) AS n_docs, sum(len)::BIGINT AS n_chars FROM corpus
WHERE period = '2001-2005' GROUP BY period""")
def period_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = base.corpus(spark, folder).filter(F.col("period") == "2001-2005")
    return docs.groupBy("period").agg(F.count("*").alias("n_docs"), F.sum("len").alias("n_chars"))


@query("doc_metadata_join", f"""WITH {CORPUS}
SELECT c.period, c."ID", len, quality, toxic FROM corpus c
LEFT JOIN labels l ON l.doc_id = c."ID" """)
def doc_metadata_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = base.corpus(spark, folder).select("period", "ID", "len")
    labels = load(spark, folder, "labels").withColumnRenamed("doc_id", "ID")
    metadata = docs.select("period", "ID").join(labels, "ID")
    return documents_with_metadata(docs, metadata).select(
        "period", "ID", "len", "quality", "toxic")


@query("reconcile_counts", f"""WITH {CORPUS},
f AS (SELECT period, count(*) AS n_files FROM corpus GROUP BY period),
d AS (SELECT period, count(DISTINCT "ID") AS n_data FROM corpus
      JOIN labels ON doc_id = "ID" GROUP BY period)
SELECT period, coalesce(n_files, 0) AS n_files, coalesce(n_data, 0) AS n_data,
       coalesce(n_files, 0) - coalesce(n_data, 0) AS diff FROM f FULL JOIN d USING (period)""")
def reconcile(spark: SparkSession, folder: str) -> DataFrame:
    files = base.corpus(spark, folder).select("period", F.col("ID").alias("DOC"))
    labels = load(spark, folder, "labels").select(F.col("doc_id").alias("DOC"))
    return reconcile_counts(files, files.join(labels, "DOC", "left_semi"))


_DOC_NAME = "concat('doc-', lpad(cast(ID as string), 12, '0'))"
_DOC_NAME_SQL = """('doc-' || lpad("ID"::VARCHAR, 12, '0'))"""


@query("next_ids", f"""WITH {CORPUS},
have AS (SELECT period, max("ID") AS max_id FROM corpus JOIN labels ON doc_id = "ID"
         GROUP BY period)
SELECT period, {_DOC_NAME_SQL} AS "DOC",
       (row_number() OVER (PARTITION BY period ORDER BY {_DOC_NAME_SQL})
        + coalesce(max_id, 0))::BIGINT AS "ID"
FROM corpus c LEFT JOIN have USING (period)
WHERE c."ID" NOT IN (SELECT doc_id FROM labels)""")
def next_ids_query(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without a label get numbers after the labelled ones of their period."""
    docs = base.corpus(spark, folder).select("period", "ID", F.expr(_DOC_NAME).alias("DOC"))
    labels = load(spark, folder, "labels").select(F.col("doc_id").alias("ID"))
    existing = docs.join(labels, "ID", "left_semi").groupBy("period").agg(
        F.max("ID").alias("max_id"))
    new = docs.join(labels, "ID", "left_anti").select("period", "DOC")
    return next_ids(new, existing).select("period", "DOC", "ID")


#: Documents that one run takes of a period: small enough to bite in every period of the test data.
BATCH = 50


@query("incremental_batch", f"""WITH {CORPUS}
SELECT period, "ID", len FROM corpus WHERE "ID" NOT IN (SELECT doc_id FROM labels)
QUALIFY row_number() OVER (PARTITION BY period ORDER BY "ID") <= {BATCH}""")
def incremental_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The next documents to process: of each period the first ones that are not done."""
    docs = base.corpus(spark, folder).select("period", "ID", "len")
    done = load(spark, folder, "labels").select(F.col("doc_id").alias("ID")).join(
        docs.select("period", "ID"), "ID")
    return pending_documents(docs, done, ["period", "ID"], BATCH, by=["period"])


# --- dates read off the text -----------------------------------------------

_GENITIVE = [words[0] for words in MONTHS.values()]


def _tail_text(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as letters that end in their date."""
    orders = load(spark, folder, "orders")
    day = F.col("o_orderdate").cast("date")
    month = F.get(F.array(*[F.lit(m) for m in _GENITIVE]), F.month(day) - 1)
    suffix = F.get(F.array(*[F.lit(s) for s in (" r.", " roku", "r.", "")]),
                   (F.col("o_orderkey") % 4).cast("int"))
    text = F.concat(F.lit("Z poważaniem, Warszawa, dnia "), F.dayofmonth(day), F.lit(" "),
                    month, F.lit(" "), F.year(day), suffix)
    return orders.select(F.col("o_orderkey").alias("DOC"), text.alias("CONTENT"))


_TAIL_TEXT_SQL = f"""
letters AS (SELECT o_orderkey AS "DOC", 'Z poważaniem, Warszawa, dnia ' || day(o_orderdate) || ' '
  || ([{base.quoted(_GENITIVE)}])[month(o_orderdate)] || ' ' || year(o_orderdate)
  || ([' r.', ' roku', 'r.', ''])[(o_orderkey % 4) + 1] AS "CONTENT" FROM orders)"""

_MONTH_CASE = "CASE m " + " ".join(
    f"WHEN '{w}' THEN {n}" for n, words in MONTHS.items() for w in words) + " END"


def _parse_sql(source: str, text: str) -> str:
    trim = r"regexp_replace({}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')".format
    strip = trim(f"regexp_replace(right({text}, 25), '{YEAR_SUFFIX}', '')")
    year = r"try_cast(replace(regexp_extract(tail, '\d+\.*$'), '.', '') AS INTEGER)"
    head = trim("substr(tail, 1, greatest(length(tail) - 4, 0))")
    before = trim(f"regexp_extract(head, '^(.*?){MONTH_PATTERN}', 1)")
    return f"""
t1 AS (SELECT *, {strip} AS tail FROM {source}),
t2 AS (SELECT *, {year} AS year, {head} AS head FROM t1),
t3 AS (SELECT *, regexp_extract(head, '{MONTH_PATTERN}') AS m,
       try_cast(regexp_extract({before}, '(\\d+)$') AS INTEGER) AS day FROM t2),
t4 AS (SELECT *, {_MONTH_CASE}::INTEGER AS month FROM t3),
parsed AS (SELECT *, try_cast(lpad(year::VARCHAR, 4, '0') || '-' || lpad(month::VARCHAR, 2, '0')
       || '-' || lpad(day::VARCHAR, 2, '0') AS DATE) AS date FROM t4)"""


@query("tail_date_parse", f"""WITH {_TAIL_TEXT_SQL}, {_parse_sql('letters', '"CONTENT"')}
SELECT "DOC", tail, year, month, day, date FROM parsed""")
def tail_date_parse(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parse_tail_date(_tail_text(spark, folder), "CONTENT")
    return parsed.select("DOC", "tail", "year", "month", "day", "date")


_OVERRIDE = "14 lipca 1998 r."
_OVERRIDDEN_SQL = f"""{_TAIL_TEXT_SQL},
fixed AS (SELECT "DOC", CASE WHEN "DOC" % 100 = 0 THEN '{_OVERRIDE}' ELSE "CONTENT" END
          AS "CONTENT" FROM letters)"""


def _overridden(spark: SparkSession, folder: str) -> DataFrame:
    letters = _tail_text(spark, folder)
    overrides = letters.filter(F.col("DOC") % 100 == 0).select(
        "DOC", F.lit(_OVERRIDE).alias("override"))
    return apply_overrides(letters, overrides, "DOC", "CONTENT")


@query("date_override", f"""WITH {_OVERRIDDEN_SQL}, {_parse_sql('fixed', '"CONTENT"')}
SELECT "DOC", date FROM parsed""")
def date_override(spark: SparkSession, folder: str) -> DataFrame:
    return parse_tail_date(_overridden(spark, folder), "CONTENT").select("DOC", "date")


@query("date_rule_violations", f"""WITH {_TAIL_TEXT_SQL}, {_parse_sql('letters', '"CONTENT"')}
SELECT "DOC", tail, 'year' AS rule FROM parsed WHERE NOT coalesce(year BETWEEN 1997 AND 2007, FALSE)
UNION ALL
SELECT "DOC", tail, 'month' FROM parsed WHERE NOT coalesce(month BETWEEN 1 AND 12, FALSE)
UNION ALL
SELECT "DOC", tail, 'day' FROM parsed WHERE NOT coalesce(day BETWEEN 1 AND 31, FALSE)""")
def date_rules(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parse_tail_date(_tail_text(spark, folder), "CONTENT")
    return date_rule_violations(parsed, ["DOC"])


# --- dates against terms ---------------------------------------------------

@query("dates_before_term", f"""WITH {CORPUS}, {BOUNDS}
SELECT "ID", period, date, (date - start_date)::INTEGER AS days_after_start
FROM corpus LEFT JOIN bounds USING (period) WHERE date - start_date < 0""")
def dates_before_term(spark: SparkSession, folder: str) -> DataFrame:
    found = stats.before_start(base.corpus(spark, folder), term_bounds(spark))
    return found.select("ID", "period", "date", "days_after_start")


@query("dates_after_term", f"""WITH {CORPUS}, {BOUNDS}
SELECT count(*) AS n, min(d) AS min_days, median(d)::DOUBLE AS median_days, max(d) AS max_days
FROM (SELECT (end_date - date)::INTEGER AS d FROM corpus LEFT JOIN bounds USING (period))
WHERE d < 0""")
def dates_after_term(spark: SparkSession, folder: str) -> DataFrame:
    return stats.after_end_summary(base.corpus(spark, folder), term_bounds(spark))


# --- lengths and days ------------------------------------------------------

@query("doc_length_stats", f"""WITH {CORPUS}
SELECT period, count(*) AS "count", count(DISTINCT "AUTHOR_CLEAN") AS authors,
       round(avg(len), 6) AS av_len, round(stddev_samp(len), 6) AS sd_len,
       min(len) AS min_len, max(len) AS max_len
FROM corpus GROUP BY period""")
def doc_length_stats(spark: SparkSession, folder: str) -> DataFrame:
    return stats.length_stats(base.corpus(spark, folder)).withColumns(
        {"av_len": F.round("av_len", 6), "sd_len": F.round("sd_len", 6)})


@query("doc_length_quantiles", f"""WITH {CORPUS}
SELECT period, round(quantile_cont(len, 0.5), 6)::DOUBLE AS q50,
       round(quantile_cont(len, 0.9), 6)::DOUBLE AS q90 FROM corpus GROUP BY period""")
def doc_length_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    found = stats.length_quantiles(base.corpus(spark, folder), {"q50": 0.5, "q90": 0.9})
    return found.select("period", F.round("q50", 6).alias("q50"), F.round("q90", 6).alias("q90"))


@query("party_null_rate", f"""WITH {CORPUS}
SELECT period, round(avg((party IS NULL)::INTEGER), 9) AS without_party
FROM corpus GROUP BY period""")
def party_null_rate(spark: SparkSession, folder: str) -> DataFrame:
    return base.corpus(spark, folder).groupBy("period").agg(
        F.round(null_rate(F.col("party")), 9).alias("without_party"))


@query("daily_docs", f'WITH {CORPUS} SELECT date, count(*) AS "count" FROM corpus GROUP BY date')
def daily_docs(spark: SparkSession, folder: str) -> DataFrame:
    return stats.daily_counts(base.corpus(spark, folder))


@query("days_since_term_start", f"""WITH {CORPUS}, {BOUNDS}
SELECT period, (date - start_date)::INTEGER AS days_by, count(*) AS "count"
FROM corpus LEFT JOIN bounds USING (period) GROUP BY ALL""")
def days_since_term_start(spark: SparkSession, folder: str) -> DataFrame:
    return stats.counts_since_start(base.corpus(spark, folder), term_bounds(spark))


@query("daily_trend", f"""WITH {CORPUS},
daily AS (SELECT period, date, count(*) AS "count" FROM corpus GROUP BY period, date)
SELECT period, date, "count", round(avg("count") OVER (PARTITION BY period ORDER BY date
  RANGE BETWEEN INTERVAL 15 DAYS PRECEDING AND INTERVAL 15 DAYS FOLLOWING), 9) AS trend
FROM daily""")
def daily_trend(spark: SparkSession, folder: str) -> DataFrame:
    daily = stats.daily_counts(base.corpus(spark, folder), "period")
    smooth = moving_average(daily, "count", "date", ["period"], 15, "trend")
    return smooth.withColumn("trend", F.round("trend", 9))


# --- overlapping windows ---------------------------------------------------

_WINDOWS_SQL = f"""{BOUNDS},
steps AS (SELECT *, ceil((end_date - start_date) / 180.0)::INTEGER AS n FROM bounds),
edges AS (SELECT period, i, CASE WHEN i = n - 1 THEN end_date
            ELSE (start_date + (i * 180)::INTEGER)::DATE END AS st
          FROM (SELECT *, unnest(range(n)) AS i FROM steps)),
led AS (SELECT period, st, lead(st, 2) OVER (PARTITION BY period ORDER BY i) AS et FROM edges),
windows AS (SELECT period, st, et, period || ' (' || strftime(st, '%Y-%m') || ' - '
            || strftime(et, '%Y-%m') || ')' AS p_label FROM led WHERE et IS NOT NULL)"""


@query("windows", f"""WITH {CORPUS}, {_WINDOWS_SQL}
SELECT w.period, st, et, p_label, (SELECT count(*) FROM corpus c WHERE c.date = st) AS on_start
FROM windows w""")
def windows(spark: SparkSession, folder: str) -> DataFrame:
    """The windows, each with the documents dated on its first day."""
    daily = stats.daily_counts(base.corpus(spark, folder)).select(
        F.col("date").alias("st"), "count")
    made = overlapping_windows(term_bounds(spark))
    return made.join(daily, "st", "left").select(
        "period", "st", "et", "p_label", F.coalesce("count", F.lit(0)).alias("on_start"))


@query("window_doc_counts", f"""WITH {CORPUS}, {_WINDOWS_SQL}
SELECT w.period, st, et, p_label, count(c."ID") AS "count"
FROM windows w LEFT JOIN corpus c ON c.date BETWEEN st AND et GROUP BY ALL""")
def window_doc_counts(spark: SparkSession, folder: str) -> DataFrame:
    return window_counts(base.corpus(spark, folder), overlapping_windows(term_bounds(spark)))


@query("window_texts", f"""WITH {base.DOCUMENTS_SQL}, {_WINDOWS_SQL}
SELECT p_label, d.period, d."ID", d."CONTENT"
FROM windows w JOIN docs d ON d.date BETWEEN st AND et""")
def window_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = base.clean_documents(spark, folder, "date")
    joined = join_windows(docs, overlapping_windows(term_bounds(spark)))
    return joined.select("p_label", "period", "ID", "CONTENT")
