"""Oxygen drops, in SQL expressions only: bad runs, segment drops, jagged drops, depth. The same rules on one recording's samples are in ``generators.oxygen_masks``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.operators.intervals import overlap_anti
from nightgrid.operators.runs import runs

BUFFER = 60
RISE, FALL = 0.5, 0.3


def bad_runs(x: DataFrame, value: str = "v") -> DataFrame:
    """runs of values <= 0, widened; the start is held at 0 before the end is taken as start + length + 2 buffers."""
    r = runs(x.withColumn("_bad", (F.col(value) <= 0).cast("int")), "_bad", "i", only=1)
    s = F.greatest(F.col("start") - BUFFER, F.lit(0))
    return r.select("subject_id", s.alias("start"), (s + F.col("length") + 2 * BUFFER - 1).alias("end"))


def with_depth(x: DataFrame, value: str = "v", ahead: int = 30) -> DataFrame:
    """How far the value falls within the next samples."""
    low = F.min(value).over(Window.partitionBy("subject_id").orderBy("i").rowsBetween(0, ahead - 1))
    return x.withColumn("depth", F.greatest(F.col(value) - low, F.lit(0.0)))


def segment_drops(x: DataFrame, threshold: float, value: str = "v") -> DataFrame:
    """F32: segments end where the value rises by more than .5; a segment with enough range drops from its first to its last fall."""
    w = Window.partitionBy("subject_id").orderBy("i")
    y = x.withColumn("_d", F.col(value) - F.lag(value).over(w)).withColumn("_s", F.sum(F.coalesce((F.col("_d") > RISE).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fall = F.when(F.col("_d") < -FALL, F.col("i"))
    g = y.groupBy("subject_id", "_s").agg((F.max(value) - F.min(value)).alias("range"), F.min(fall).alias("start"), F.max(fall).alias("end"))
    return g.filter((F.col("range") >= threshold) & F.col("start").isNotNull()).drop("_s")


def jagged_drops(x: DataFrame, threshold: float, value: str = "v", ahead: int = 30) -> DataFrame:
    """where the value lies more than ``threshold`` above the least of the next samples, from the end of such a run to that least."""
    w = Window.partitionBy("subject_id").orderBy("i")
    near = w.rowsBetween(0, ahead - 1)
    y = x.withColumns({"_c": F.col(value) - F.min(value).over(near) > threshold, "end": F.min(F.struct(F.col(value), F.col("i"))).over(near)["i"]})
    y = y.withColumn("_next", F.coalesce(F.lead("_c").over(w), F.lit(False)))
    return y.filter("_c AND NOT _next").select("subject_id", F.col("i").alias("start"), "end")


def clean_drops(x: DataFrame, threshold: float, value: str = "v") -> DataFrame:
    """Samples in a segment drop or a jagged one, as runs that touch no bad run."""
    d = segment_drops(x, threshold, value).select("subject_id", "start", "end").unionByName(jagged_drops(x, threshold, value))
    w = Window.partitionBy("subject_id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.coalesce((F.col("start") > before + 1).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_before", before).withColumn("_run", run).groupBy("subject_id", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return overlap_anti(d.drop("_run").withColumn("id", F.col("start")), bad_runs(x, value), "id", bucket=4096).drop("id")
