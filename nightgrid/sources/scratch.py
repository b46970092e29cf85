"""Tables of the engine's own in the folder that driver and executors share: they cut lineage and fix what a rerun could deal out anew."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a temporary folder only where it is unset and all runs on one machine (tests)."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    base = sc.getConf().get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="nightgrid-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a name in whatever store it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that goes when the session ends."""
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}-{name}"
    fs, p = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a stored table."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
