"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it names none, a temporary folder serves a local master, whose
    executors are the driver; a cluster gets an error, since its executors would not see each other's files."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lexloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/lexloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and reread it: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, in whatever store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete the files that ``df``, a table of ``materialise`` that nothing reads any more, was read from."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lexloom/" in folder:
            remove(df.sparkSession, folder)


def sweep(spark: SparkSession, hours: float = 24.0) -> int:
    """Delete the intermediate tables of this library, whichever session wrote them, that were last changed more than
    ``hours`` ago, and tell how many. Results that are still read from such a table must be stored elsewhere first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lexloom")
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return 0
    oldest = time.time() * 1000 - hours * 3_600_000
    old = [s.getPath() for s in store.listStatus(root) if s.getModificationTime() < oldest]
    return sum(store.delete(path, True) for path in old)
