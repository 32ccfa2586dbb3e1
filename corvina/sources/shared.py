"""The shared work folder, files in it, and broadcasts of checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in counted rows times the row width given by the caller, that is broadcast.
BROADCAST_BYTES = 16 << 20
#: Largest table, by the plan's statistics, that spread() deals anew.
SPREAD_BYTES = 4 << 30


def work_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one in local mode, else the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        local = spark.sparkContext.master.startswith("local")
        path = "file://" + tempfile.mkdtemp(prefix="corvina-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/corvina/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The path as the JVM's object, and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = file_system(spark, path)
    return fs.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    target, fs = file_system(spark, path)
    fs.delete(target, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    target, fs = file_system(spark, old)
    return fs.exists(target) and fs.rename(target, file_system(spark, new)[0])


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.corvina_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what materialise() wrote for df, once nothing reads it any more."""
    if path := getattr(df, "corvina_path", None):
        delete(df.sparkSession, path)


def is_small(df: DataFrame, row_bytes: int) -> bool:
    """Whether the counted rows of df stay under BROADCAST_BYTES; counting stops at that size."""
    most = BROADCAST_BYTES // row_bytes
    return df.limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df marked for broadcast if is_small()."""
    return F.broadcast(df) if is_small(df, row_bytes) else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt to two tasks a core, where the plan's statistics say that its rows take little: for costly work on each row.

    A small file, or one group of rows in it, is read by one task, which would do all that work. Larger tables are read by
    many tasks and stay as they are, as do rows whose size is not known and rows that have been dealt before.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if "Repartition" in plan.toString() or not 0 <= int(str(plan.stats().sizeInBytes())) <= SPREAD_BYTES:
        return df
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
