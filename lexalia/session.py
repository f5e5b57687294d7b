"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SHARED_DIR_CONF = "spark.checkpoint.dir"


def build_session(app: str = "lexalia", cores: str = "*", shuffle_partitions: int = 8,
                  **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use.

    On a cluster the session comes from spark-submit and this is not called.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Where that is not set, a folder in the warehouse; an error on a cluster whose warehouse is a folder
    of one machine. Spark removes the folder when the application ends.
    """
    base = spark.conf.get(_SHARED_DIR_CONF, None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"
        files, _ = _file_system(spark, base)
        if files.getUri().getScheme() == "file" and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_SHARED_DIR_CONF} must name a folder that all executors reach")
    return _own_folder(spark, f"{base.rstrip('/')}/{spark.sparkContext.applicationId}")


_folders: set[str] = set()


def _own_folder(spark: SparkSession, folder: str) -> str:
    if folder not in _folders:
        files, path = _file_system(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders.add(folder)
    return folder


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def file_uri(spark: SparkSession, folder: str) -> str:
    """``folder`` with its file system, in the form that readers outside the JVM take."""
    files, path = _file_system(spark, folder)
    uri = files.makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file, or of all files of a folder."""
    files, where = _file_system(spark, path)
    return files.getContentSummary(where).getLength()


_SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"


def at_least_partitions(spark: SparkSession, count: int) -> None:
    """Raise the session's number of shuffle partitions to ``count`` where it is lower, so that none grows with the input."""
    if int(spark.conf.get(_SHUFFLE_PARTITIONS)) < count:
        spark.conf.set(_SHUFFLE_PARTITIONS, str(count))


def staging_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside are deleted when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame, label: str = "stage", replaces: DataFrame | None = None,
                compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back; its shuffle files go.

    Survives lost executors, keeps columns prunable and gives the optimiser
    real sizes for the next joins, so iterative operators re-plan each round.
    ``replaces`` names a table of this kind that nothing reads any more: its
    files go, so a loop keeps one state on disk.
    """
    spark = df.sparkSession
    path = staging_path(spark, label)
    with shuffles_go(spark):
        df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    drop_stage(replaces)
    return out


def drop_stage(df: DataFrame | None) -> None:
    """Delete the files of a table written by ``cut_lineage`` that is not needed any more."""
    path = getattr(df, "stage_path", None) if df is not None else None
    if path:
        files, where = _file_system(df.sparkSession, path)
        files.delete(where, True)
