"""Pairs of items that share a key, with the work on hot keys split up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def pairs_sharing_key(df: DataFrame, key: list[str], item: str, carry: list[str],
                      block_rows: int = 2000) -> DataFrame:
    """``key, id_a < id_b`` and ``carry`` columns of both sides.

    A key held by more than ``block_rows`` items is cut into blocks of about
    that many; each block meets each other block in a join group of its own,
    so the largest group is bounded however hot the key is.  Keys held by one
    item are dropped first.
    """
    sizes = (df.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
             .select(*key, F.ceil(F.col("_n") / F.lit(block_rows)).cast("int")
                     .alias("_blocks")))
    placed = df.select(*key, item, *carry).join(sizes, key).withColumn(
        "_b", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))
    row = F.explode(F.sequence(F.col("_b"), F.col("_blocks") - 1)).alias("_j")
    col = F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i")
    left = placed.select(*key, F.col("_b").alias("_i"), row, F.col(item).alias("_x"),
                         *[F.col(c).alias(f"_x_{c}") for c in carry])
    right = placed.select(*key, F.col("_b").alias("_j"), col, F.col(item).alias("_y"),
                          *[F.col(c).alias(f"_y_{c}") for c in carry])
    met = left.join(right, [*key, "_i", "_j"]).filter(
        ((F.col("_i") < F.col("_j")) & (F.col("_x") != F.col("_y")))
        | (F.col("_x") < F.col("_y")))
    swap = F.col("_x") > F.col("_y")
    both = []
    for c in carry:
        x, y = F.col(f"_x_{c}"), F.col(f"_y_{c}")
        both += [F.when(swap, y).otherwise(x).alias(f"{c}_a"),
                 F.when(swap, x).otherwise(y).alias(f"{c}_b")]
    return met.select(*key, F.least("_x", "_y").alias("id_a"),
                      F.greatest("_x", "_y").alias("id_b"), *both)
