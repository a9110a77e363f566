"""Durable intermediate tables.

An intermediate that several branches read is written once as Parquet in a folder that every
executor reaches. That cuts the lineage, so a lost executor costs a re-read and not a
recomputation, and gives the planner the true size of the table when it picks a join strategy.
"""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_STAGED: list[str] = []
_PATH_OF: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_TABLES: list[str] = []


def scratch_root(spark: SparkSession, folder: str | None = None) -> str:
    """The folder for intermediates: ``folder``, else ``spark.checkpoint.dir``, else the warehouse.

    The warehouse serves only where everything that runs tasks can read it: with a ``file:``
    warehouse that is a session on one machine, anywhere else an error is raised.
    """
    configured = folder or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    one_machine = spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")
    if warehouse.startswith(("file:", "/")) and not one_machine:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse.rstrip('/')}/scratch"


def scratch(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new path below the folder for intermediates, which ``release`` removes."""
    path = f"{scratch_root(spark, folder)}/faultline/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


@contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark drops a job's shuffle files when the job ends, not when their objects are collected some time."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stage(
    df: DataFrame, name: str, folder: str | None = None, clean: bool = False, rows_per_file: int = 0, codec: str | None = None
) -> DataFrame:
    """Write ``df`` once and return a scan of what was written.

    With ``clean`` the shuffle files of the job go as soon as the table is written. ``rows_per_file`` cuts the files of
    tables with large rows, ``codec`` is the compression of the files.
    """
    spark = df.sparkSession
    path = scratch(spark, name, folder)
    schema = df.schema
    write = df.write.option("maxRecordsPerFile", rows_per_file)
    with without_shuffles(spark) if clean else nullcontext():
        (write.option("compression", codec) if codec else write).parquet(path)
    staged = spark.read.schema(schema).parquet(path)
    _PATH_OF[staged] = path
    return staged


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stage`` has returned and that nothing, lazy results included, will read again; others stay."""
    for table in tables:
        path = _PATH_OF.pop(table, None)
        if path in _STAGED:
            _STAGED.remove(path)
            _delete(table.sparkSession, path)


def stage_bucketed(df: DataFrame, name: str, column: str, buckets: int, folder: str | None = None) -> DataFrame:
    """As ``stage``, kept in ``buckets`` by ``column``: grouping the scan by it needs no shuffle."""
    spark = df.sparkSession
    table = f"faultline_{name}_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark, folder)}/faultline/{table}"
    _STAGED.append(path)
    _TABLES.append(table)
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(table)
    return spark.table(table)


def release(spark: SparkSession) -> None:
    """Remove every intermediate of this process, once the results made from them are stored."""
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _STAGED:
        _delete(spark, _STAGED.pop())


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
