"""Spark-side helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexalia.session import cut_lineage


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``, after the session's Arrow batches have been held to 8 MB where it sets no lower bound.

    By rows alone a batch of long texts has no bound in bytes.
    """
    conf = docs.sparkSession.conf
    now = conf.get(_BATCH_BYTES).rstrip("bB")
    if not now.isdigit() or int(now) > 8 << 20:
        conf.set(_BATCH_BYTES, str(8 << 20))
    return docs


#: Two hashes of id and text, 96 bits together, by which operators join back to documents.
KEY = ["_h", "_g"]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, the key, and ``_text``.

    Rows equal in id and text share the key and so get the same result; rows with one id but
    different texts, or with a null id, stay apart.
    """
    return bounded(docs).select(F.col(id_col).alias("_id"), *key(id_col, text_col),
                       F.col(text_col).cast("string").alias("_text"))


def key(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(id_col, text_col).alias("_h"), F.hash(id_col, text_col).alias("_g")]


def stage(df: DataFrame, label: str, replaces: DataFrame | None = None) -> DataFrame:
    """A small table written to the shared folder, so that several consumers read it."""
    return cut_lineage(df, label, replaces)


def crc_mod(id_col: Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus
