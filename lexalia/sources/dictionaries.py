"""JSON dictionaries: member rosters and date overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROSTER_TYPE = "map<string, map<string, array<string>>>"
OVERRIDE_TYPE = "map<string, array<string>>"


def _whole_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))


def flatten_roster(df: DataFrame, json: str = "json") -> DataFrame:
    """``period → party → [names]`` objects to ``AUTHOR, ugr, period`` rows."""
    periods = df.select(F.explode(F.from_json(json, ROSTER_TYPE)).alias("period", "parties"))
    parties = periods.select("period", F.explode("parties").alias("ugr", "names"))
    return parties.select(F.explode("names").alias("AUTHOR"), "ugr", "period")


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    return flatten_roster(_whole_json(spark, path))


def flatten_overrides(df: DataFrame, json: str = "json") -> DataFrame:
    """``DOC → [text]`` objects to ``DOC, override`` rows (first text counts)."""
    entries = df.select(F.explode(F.from_json(json, OVERRIDE_TYPE)).alias("DOC", "texts"))
    return entries.select("DOC", F.get("texts", F.lit(0)).alias("override"))


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    return flatten_overrides(_whole_json(spark, path))


def replace_row(df: DataFrame, drop_where: Column, new_rows: DataFrame) -> DataFrame:
    """Filter rows out and append their replacement."""
    return df.filter(~F.coalesce(drop_where, F.lit(False))).unionByName(new_rows)
