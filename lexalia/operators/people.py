"""Authors, rosters and how well they match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexalia.functions.names import party_short, short_name
from lexalia.operators.aggregates import count_distinct, numbered_values


def first_match(lookup: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one with the smallest ``order`` value.

    An aggregate, so a key with very many rows is reduced before the shuffle.
    """
    rest = [c for c in lookup.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.col(order)).alias("_row")
    return lookup.groupBy(*keys).agg(best).select(*keys, "_row.*")


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str, column: str,
                    value: str = "override") -> DataFrame:
    """Replace ``column`` where the key has an override; the first one counts."""
    single = first_match(overrides.select(key, value), [key], value)
    return (df.join(single, key, "left")
            .withColumn(column, F.coalesce(value, column)).drop(value))


def roster_duplicates(roster: DataFrame) -> DataFrame:
    """Names listed more than once in a period.

    ``period, n, uq, any_duplicates, position, member_dup``, one row per repeated
    name; a name listed three times is shown twice.  A period without duplicates
    keeps one row with position 0 and an empty name.
    """
    per_name = roster.groupBy("period", "AUTHOR").agg(F.count("*").alias("_times"))
    sizes = per_name.groupBy("period").agg(F.sum("_times").alias("n"), F.count("*").alias("uq"))
    again = per_name.filter(F.col("_times") > 1).select(
        "period", F.explode(F.array_repeat("AUTHOR", (F.col("_times") - 1).cast("int")))
        .alias("AUTHOR"))
    names = numbered_values(again, ["period"], "AUTHOR", "member_dup")
    return sizes.join(names, "period", "left").select(
        "period", "n", "uq", (F.col("n") > F.col("uq")).alias("any_duplicates"),
        F.coalesce("position", F.lit(0)).alias("position"),
        F.coalesce("member_dup", F.lit("")).alias("member_dup"))


def _documents_per_author(docs: DataFrame) -> DataFrame:
    """Counted before any join, so a very active author is one row."""
    return docs.groupBy("AUTHOR", "period").agg(F.count("*").alias("_n"))


def _weighted_null_rate(column: Column) -> Column:
    return F.sum(F.when(column.isNull(), F.col("_n")).otherwise(0)) / F.sum("_n")


def unmatched_rates(docs: DataFrame, roster: DataFrame) -> DataFrame:
    """Per period: documents and authors without an entry in the roster."""
    entry = roster.select("AUTHOR", "period", "ugr")
    joined = _documents_per_author(docs).join(entry, ["AUTHOR", "period"], "left")
    unknown = F.col("ugr").isNull()
    return joined.groupBy("period").agg(
        count_distinct(F.col("AUTHOR"), True).alias("n_mem"),
        F.sum("_n").alias("count"), _weighted_null_rate(F.col("ugr")).alias("without_party"),
        F.countDistinct(F.when(unknown, F.col("AUTHOR"))).alias("n_mem_without_party"),
    ).withColumn("without_part_count", F.col("n_mem_without_party") / F.col("n_mem"))


def unmatched_authors(docs: DataFrame, roster: DataFrame, n: int = 6) -> DataFrame:
    """First ``n`` authors, in name order, that the roster does not know."""
    entry = roster.select("AUTHOR", "period", "ugr")
    joined = _documents_per_author(docs).join(entry, ["AUTHOR", "period"], "left")
    return (joined.filter(F.col("ugr").isNull()).groupBy("AUTHOR", "ugr")
            .agg(F.sum("_n").alias("k")).orderBy("AUTHOR").limit(n))


def author_map(docs: DataFrame, roster: DataFrame, shorten_party: bool = False) -> DataFrame:
    """``AUTHOR, period, stripped, ugr, ugr2`` for each spelling in use.

    ``ugr`` is the party under the name as written, ``ugr2`` under the
    shortened name.
    """
    names = docs.select("AUTHOR", "period").distinct().withColumn(
        "stripped", short_name(F.col("AUTHOR")))
    as_written = roster.select("AUTHOR", "period", "ugr")
    as_short = roster.select(F.col("AUTHOR").alias("stripped"), "period",
                             F.col("ugr").alias("ugr2"))
    mapped = (names.join(as_written, ["AUTHOR", "period"], "left")
              .join(as_short, ["stripped", "period"], "left"))
    if shorten_party:
        mapped = mapped.withColumn("ugr2", party_short(F.col("ugr2")))
    return mapped.select("AUTHOR", "period", "stripped", "ugr", "ugr2").distinct()


def match_rates(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Unmatched share per period before and after shortening the names."""
    joined = _documents_per_author(docs).join(mapping, ["AUTHOR", "period"], "left")
    return joined.groupBy("period").agg(
        count_distinct(F.col("AUTHOR"), True).alias("count_original"),
        count_distinct(F.col("stripped"), True).alias("count_clean"),
        F.sum("_n").alias("count_int"),
        _weighted_null_rate(F.col("ugr")).alias("perc_without_original"),
        _weighted_null_rate(F.col("ugr2")).alias("perc_without_clean"))


def attach_authors(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add ``AUTHOR_CLEAN`` and ``party`` to every document."""
    single = mapping.select("AUTHOR", "period", F.col("stripped").alias("AUTHOR_CLEAN"),
                            F.col("ugr2").alias("party")).distinct()
    return docs.join(single, ["AUTHOR", "period"], "left")


def members_in_all_periods(docs: DataFrame, n_periods: int) -> DataFrame:
    """Authors with a party who wrote in every period, with their document count."""
    known = docs.filter(F.col("party").isNotNull())
    return (known.groupBy("AUTHOR_CLEAN")
            .agg(F.countDistinct("period").alias("dist_period"), F.count("*").alias("n_int"))
            .filter(F.col("dist_period") == n_periods))
