"""Ranking and within-group scaling.

The helpers that may meet large groups use an aggregate joined back to the
rows, never a window over the whole group, so no group lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexalia.session import cut_lineage


def with_group_stats(df: DataFrame, by: list[str], **stats: Column) -> DataFrame:
    """Attach per-group aggregates to every row; NULL keys form a group of their own."""
    if not by:
        totals = df.agg(*[c.alias(n) for n, c in stats.items()])
        return df.select("*", *[totals.select(n).scalar().alias(n) for n in stats])
    keys = [f"_k{i}" for i in range(len(by))]
    totals = df.groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys)]).agg(
        *[c.alias(n) for n, c in stats.items()])
    match = F.lit(True)
    for b, k in zip(by, keys):
        match = match & df[b].eqNullSafe(totals[k])
    return df.join(totals, match, "inner").drop(*keys)


def top_n_with_ties(df: DataFrame, n: int, weight: str, by: list[str] | None = None,
                    staged: bool = False) -> DataFrame:
    """Rows whose weight is among the ``n`` largest, ties kept.

    The n-th largest weight is found with at most ``n`` rows per task and
    group; rows are then filtered where they are, so even a tie held by most
    rows stays spread out.  The input is read twice and therefore written once,
    unless it is ``staged`` already.
    """
    by = by or []
    known = df.filter(F.col(weight).isNotNull())
    if not staged:
        known = cut_lineage(known, "ranked")
    if not by:
        cut = known.select(weight).orderBy(F.desc(weight)).limit(n)
        return known.filter(F.col(weight) >= cut.agg(F.min(weight)).scalar())
    order = Window.partitionBy(*by).orderBy(F.desc(weight))
    cut = (known.select(*by, weight).withColumn("_rn", F.row_number().over(order))
           .filter(F.col("_rn") <= n).groupBy(*by).agg(F.min(weight).alias("_cut")))
    return known.join(cut, by).filter(F.col(weight) >= F.col("_cut")).drop("_cut")


def first_n_per_group(df: DataFrame, n: int, by: list[str], order: list[Column],
                      name: str = "rn") -> DataFrame:
    """Exactly the first ``n`` rows per group, numbered.

    The filter on the row number lets Spark keep only ``n`` rows per group and
    task before the shuffle.
    """
    spec = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(spec)).filter(F.col(name) <= n)


def number_rows(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Row numbers inside groups that an earlier top-n has made short."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def rescale(x: Column, low: Column, high: Column, target: tuple[float, float]) -> Column:
    """Map ``[low, high]`` to ``target``; an empty range gives NULL."""
    lo, hi = min(target), max(target)
    return F.lit(lo) + F.lit(hi - lo) * (x - low) / F.nullif(high - low, F.lit(0.0))


def rescale_within(df: DataFrame, column: str, by: list[str], target: tuple[float, float],
                   name: str) -> DataFrame:
    known = with_group_stats(df, by, _lo=F.min(column), _hi=F.max(column))
    scaled = rescale(F.col(column), F.col("_lo"), F.col("_hi"), target)
    return known.withColumn(name, scaled).drop("_lo", "_hi")


def zscore_within(df: DataFrame, column: str, by: list[str], name: str) -> DataFrame:
    """``(x - mean) / sample standard deviation``; no spread gives NULL."""
    known = with_group_stats(df, by, _avg=F.avg(column), _sd=F.stddev_samp(column))
    z = (F.col(column) - F.col("_avg")) / F.nullif(F.col("_sd"), F.lit(0.0))
    return known.withColumn(name, z).drop("_avg", "_sd")


def percent_share(df: DataFrame, column: str, by: list[str], name: str) -> DataFrame:
    """Whole percent of the group total, rounded half to even."""
    known = with_group_stats(df, by, _total=F.sum(column))
    share = F.bround(100 * F.col(column) / F.nullif(F.col("_total"), F.lit(0)), 0)
    return known.withColumn(name, share.cast("long")).drop("_total")


def moving_average(df: DataFrame, column: str, day: str, by: list[str], reach: int,
                   name: str) -> DataFrame:
    """Mean over the calendar days ``day ± reach``.

    Expects one row per group and day, so a group is as long as the calendar.
    """
    spec = (Window.partitionBy(*by).orderBy(F.unix_date(F.col(day)))
            .rangeBetween(-reach, reach))
    return df.withColumn(name, F.avg(column).over(spec))
