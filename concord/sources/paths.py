"""Where intermediate results go: a folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``. Only on a master ``local`` may that be
    unset: a temporary folder of this machine serves then; anywhere else it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="concord-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = f"file://{_own[0]}"
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a cut in the lineage
    that outlives any executor. :func:`discard` removes it."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_folder = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through the Hadoop file system that owns it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in the file system that owns it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def discard(*frames: DataFrame) -> None:
    """Remove what :func:`materialize` wrote for frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "shared_folder", None):
            delete_path(df.sparkSession, path)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder, none if it is not there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []
