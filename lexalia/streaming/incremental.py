"""Incremental forms: resumable ingest and windowed counts on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lexalia.operators.tokens import lemmatise, pending_documents, token_rows


def tag_pending(docs: DataFrame, done: DataFrame, max_docs: int | None = None,
                dictionary: DataFrame | None = None) -> DataFrame:
    """Token rows of the documents the ``tagged`` table lacks, ``max_docs`` of each period if given.

    An empty backlog gives no rows.
    """
    todo = pending_documents(docs, done, ["period", "ID"], max_docs, by=["period"])
    return lemmatise(token_rows(todo, ["period", "ID"], "CONTENT"), dictionary)


def stream_files(spark: SparkSession, path: str, schema: T.StructType,
                 files_per_trigger: int | None = 1, fmt: str = "parquet") -> DataFrame:
    """Unbounded reader over a folder; each file is taken once, all that are there at once for None."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def run_to_table(stream: DataFrame, target: str, checkpoint: str,
                 mode: str = "append", partition_by: list[str] | None = None) -> None:
    """Process what is there, append it to Parquet, and stop.

    A second run with the same checkpoint takes only new files.
    """
    writer = (stream.writeStream.format("parquet").outputMode(mode)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start(target).awaitTermination()


def run_complete(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Process what is there and leave the current aggregate at ``target``."""
    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    (stream.writeStream.outputMode("complete").foreachBatch(replace)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True)
     .start().awaitTermination())


def run_closed(stream: DataFrame, target: str, checkpoint: str) -> list[dict]:
    """Process what is there and append the groups that the watermark has closed; progress per batch.

    A group leaves the state when it is written, so the state holds open groups only. Every batch has a
    folder of its own, which a batch that runs again after a failure writes again: no row comes twice.
    """
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    run = (stream.writeStream.outputMode("append").foreachBatch(put)
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    run.awaitTermination()
    return [{"batch": p["batchId"], "open": sum(s["numRowsTotal"] for s in p["stateOperators"]),
             "late": sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])} for p in run.recentProgress]


def tagging_stream(docs: DataFrame) -> DataFrame:
    """The tagging step on a document stream (stateless)."""
    return lemmatise(token_rows(docs, ["period", "ID"], "CONTENT"))


def windowed_counts(stream: DataFrame, ts: str, width: str = "360 days",
                    slide: str = "180 days", start: str = "0 seconds",
                    lateness: str = "1 day", by: list[str] | None = None) -> DataFrame:
    """Counts per overlapping window; late rows are accepted up to ``lateness``.

    Works on a stream and, with the same result, on a batch.
    """
    span = F.window(ts, width, slide, start)
    keyed = stream.withWatermark(ts, lateness).groupBy(span.alias("w"), *(by or []))
    return keyed.agg(F.count("*").alias("count")).select(
        F.col("w.start").alias("st"), F.col("w.end").alias("et"), *(by or []), "count")
