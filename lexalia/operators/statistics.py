"""Descriptive statistics of documents and terms over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexalia.operators.aggregates import exact_quantiles
from lexalia.operators.ranking import top_n_with_ties


def length_stats(docs: DataFrame, author: str = "AUTHOR_CLEAN") -> DataFrame:
    """Documents, authors and length statistics per period."""
    return docs.groupBy("period").agg(
        F.count("*").alias("count"), F.countDistinct(author).alias("authors"),
        F.avg("len").alias("av_len"), F.stddev_samp("len").alias("sd_len"),
        F.min("len").alias("min_len"), F.max("len").alias("max_len"))


def daily_counts(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.groupBy(*keys, "date").agg(F.count("*").alias("count"))


def counts_since_start(docs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Documents per period and day counted from the period's start."""
    daily = daily_counts(docs, "period").join(bounds, "period", "left")
    return daily.select("period", F.datediff("date", "start_date").alias("days_by"), "count")


def before_start(docs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Documents dated before their period began."""
    known = docs.join(bounds, "period", "left")
    return known.withColumn("days_after_start", F.datediff("date", "start_date")).filter(
        F.col("days_after_start") < 0)


def after_end_summary(docs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Count, smallest, median and largest distance past the period's end."""
    late = (docs.join(bounds, "period", "left")
            .select(F.datediff("end_date", "date").alias("d")).filter(F.col("d") < 0))
    return late.agg(F.count("*").alias("n"), F.min("d").alias("min_days"),
                    F.median("d").alias("median_days"), F.max("d").alias("max_days"))


def term_days(tokens: DataFrame, docs: DataFrame | None = None, term: str = "TAGGED"
              ) -> DataFrame:
    """``term, date, count, n_ids``: occurrences and documents per term and day.

    Tokens carry ``period, ID`` and either ``date`` or get it from ``docs``.
    Each document is reduced to one row per term first, so documents are
    counted, not compared.
    """
    if docs is None:
        per_doc = tokens.groupBy("period", "ID", "date", term).agg(F.count("*").alias("_n"))
    else:
        per_doc = (tokens.groupBy("period", "ID", term).agg(F.count("*").alias("_n"))
                   .join(docs.select("period", "ID", "date"), ["period", "ID"], "left"))
    return per_doc.groupBy(term, "date").agg(
        F.sum("_n").alias("count"), F.count("*").alias("n_ids"))


def peak_terms(days: DataFrame, measure: str, n: int, name: str, term: str = "TAGGED"
               ) -> DataFrame:
    """Terms with the highest single-day value, ties kept."""
    peaks = days.groupBy(term).agg(F.max(measure).alias(name))
    return top_n_with_ties(peaks, n, name)


def volatile_terms(days: DataFrame, n: int = 15, min_days: int = 100, digits: int = 9,
                   term: str = "TAGGED") -> DataFrame:
    """Terms whose daily count varies most, among those spread over time."""
    stats = days.groupBy(term).agg(
        F.datediff(F.max("date"), F.min("date")).alias("n_days"),
        F.round(F.stddev_samp("count"), digits).alias("mn"))
    return top_n_with_ties(stats.filter(F.col("n_days") > min_days), n, "mn")


def term_series(days: DataFrame, chosen: DataFrame, term: str = "TAGGED") -> DataFrame:
    """Daily rows of the chosen terms."""
    return days.join(chosen.select(term).distinct(), term, "left_semi")


def length_quantiles(docs: DataFrame, probs: dict[str, float]) -> DataFrame:
    return exact_quantiles(docs, ["period"], "len", probs)
