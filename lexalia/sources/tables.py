"""Stored tables: create, drop, append and scan, partitioned by ``period``."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lexalia.session import file_uri


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def create_table(spark: SparkSession, name: str, schema: T.StructType,
                 location: str | None = None, partition_by: str = "period") -> bool:
    """Create an empty Parquet table; False when it is there already."""
    if spark.catalog.tableExists(name):
        return False
    writer = spark.createDataFrame([], schema).write.format("parquet")
    if partition_by in schema.fieldNames():
        writer = writer.partitionBy(partition_by)
    if location:
        writer = writer.option("path", location)
    writer.saveAsTable(name)
    return True


def create_tables(spark: SparkSession, schemas: Mapping[str, T.StructType],
                  location: str | None = None, prefix: str = "") -> list[str]:
    """Create every missing table of ``schemas``; returns the names created."""
    return [
        prefix + name for name, schema in schemas.items()
        if create_table(spark, prefix + name, schema,
                        f"{location}/{prefix}{name}" if location else None)
    ]


def reset_tables(spark: SparkSession, names: Iterable[str] | None = None) -> None:
    """Drop the named tables, or every table of the current database."""
    if names is None:
        names = [t.name for t in spark.catalog.listTables() if not t.isTemporary]
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def append_rows(df: DataFrame, name: str, schema: T.StructType) -> None:
    """Append to a table made by ``create_table``; columns go by name."""
    data = [f for f in schema.fieldNames() if f != "period"]
    keys = [f for f in schema.fieldNames() if f == "period"]
    df.select(*data, *keys).write.insertInto(name)


def write_partitioned(df: DataFrame, path: str, mode: str = "append") -> None:
    """One folder per period; rows of a period are spread over all tasks."""
    df.write.mode(mode).partitionBy("period").parquet(path)


def write_token_csv(tokens: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Token rows as ``;``-separated text."""
    tokens.write.mode(mode).option("header", True).option("sep", ";").csv(path)


def read_token_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("sep", ";").csv(path))


def write_files(rows: DataFrame, folder: str) -> int:
    """One file below ``folder`` for each ``path, value`` row, written by the tasks; how many.

    A task that runs again writes the same files again. ``folder`` must be on a file system that
    pyarrow opens.
    """
    base = file_uri(rows.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(base)
        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist()):
                files.create_dir(posixpath.dirname(f"{root}/{path}"), recursive=True)
                with files.open_output_stream(f"{root}/{path}", compression=None) as out:
                    out.write((value or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    done = rows.select("path", "value").mapInArrow(write, "n long")
    return done.agg(F.sum("n")).first()[0] or 0


def save_bucketed(df: DataFrame, name: str, location: str, key: str = "ID", buckets: int = 8) -> DataFrame:
    """Save as table ``name``: one folder per period, and in each the rows dealt into buckets by ``key``.

    Filters on ``period`` then read only their folders, at planning or, joined to filtered periods, at
    run time. Tables with as many buckets join and group by period and key without moving a row
    (``spark.sql.requireAllClusterKeysForCoPartition`` must be false, as ``build_session`` sets it).
    """
    (df.repartition(buckets, key).write.format("parquet").option("path", location).partitionBy("period")
     .bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    return df.sparkSession.table(name)


def documents_with_metadata(content: DataFrame, metadata: DataFrame) -> DataFrame:
    """Content rows with their metadata (left join on the document key)."""
    return content.join(metadata, ["period", "ID"], "left")


def reconcile_counts(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files found against documents stored, per period.

    Both sides need ``period`` and ``DOC``.
    """
    found = files.groupBy("period").agg(F.count("*").alias("n_files"))
    kept = stored.groupBy("period").agg(F.countDistinct("DOC").alias("n_data"))
    joined = found.join(kept, "period", "full")
    n_files = F.coalesce("n_files", F.lit(0)).cast("long")
    n_data = F.coalesce("n_data", F.lit(0)).cast("long")
    return joined.select("period", n_files.alias("n_files"), n_data.alias("n_data"),
                         (n_files - n_data).alias("diff"))
