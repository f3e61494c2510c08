"""Tables in the folder that all executors share.

Whatever is read twice, or would carry a long lineage, is written there as Parquet. Unlike an executor's
cache or a local checkpoint, the files outlive lost executors.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[str, SparkSession] = {}
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local master, as in tests, may do without."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _local.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="quillstone-")
        _local[context.applicationId] = where
    return where.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is free, and is deleted when the session's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_drop_all)
    _made[path] = spark
    return path


def stash(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write `df` as Parquet into the shared folder and return the written table, which cuts the lineage."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    # Nothing reads the shuffles of this write after it, so their files may go at its end.
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed = path  # what `unstash` deletes
    return out


def unstash(*tables: DataFrame | None) -> None:
    """Delete tables of `stash` that no plan reads any more."""
    for table in tables:
        path = getattr(table, "_stashed", None)
        if path in _made:
            drop_path(_made.pop(path), path)


def _drop_all() -> None:
    for path, spark in _made.items():
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001, PERF203 - the session may be gone at exit
            return


def numbered(rows: DataFrame, *by: Column, name: str = "number") -> DataFrame:
    """`rows` with their place (from 0) in the order of `by`, as a column; sorted in ranges, of which only the sizes meet."""
    spread = stash(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = spread.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return spread.withColumn("_place", place).join(F.broadcast(ranges), "_range").withColumn(name, F.col("_place") + F.col("_ahead") - 1).drop("_range", "_place", "_ahead")


def told_apart(rows: DataFrame) -> DataFrame:
    """Distinct rows, dealt by all their columns first: told apart where they are read, those of a large file would be in one task's memory."""
    return rows.repartition(*rows.columns).distinct()


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path as its object)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop_path(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)
