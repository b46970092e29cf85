"""Tables that cut lineage: written to the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that go to a Python worker at once; several workers share an executor's memory.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A temporary one is made only where none is set and all runs on one machine (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        else:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="nightgrid-")
            sc.setCheckpointDir(base)
    return base.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small where the session has Spark's default of 64 MB; a set value stays."""
    if spark.conf.get(_BATCH, "64MB").lower() in ("64mb", "64m", "67108864b", "67108864"):
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession):
    """While open, shuffle files of a finished write are removed at once."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; removed when the session ends."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}-{name}"
    with tidy_shuffles(spark):
        df.write.parquet(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores in front as no taken name has (Spark does not tell case apart)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table by Spark's own reader, so any store that Spark knows will do."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
