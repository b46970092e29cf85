"""Signal quality rules and event, track and example builders (survey 2.2, 2.13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bad_second(line: str, ecg_corr: str, ptp: str, flat: str, emg: bool = False) -> Column:
    """P10: mains share, ECG leakage, range or flatness out of bounds; an EMG is judged by flatness only."""
    f = F.col(flat) >= 0.5
    return f if emg else (F.col(line) >= 0.5) | (F.col(ecg_corr) >= 0.9) | (F.col(ptp) >= 800) | f


def unusable(pairs: list[tuple[str, str]], singles: list[str], all_flat: str, level: int) -> Column:
    """Level 1 needs every channel flat; level 2 a pair with both leads bad; level 3 any single channel as well."""
    out = F.col(all_flat)
    if level >= 2:
        for a, b in pairs:
            out = out | (F.col(a) & F.col(b))
    if level >= 3:
        for s in singles:
            out = out | F.col(s)
    return out


def lead_weight(left_bad: str, right_bad: str) -> Column:
    """the good lead alone if exactly one is bad, else half and half."""
    return F.when(F.col(left_bad) == F.col(right_bad), 0.5).when(F.col(left_bad), 0.0).otherwise(1.0)


def period_events(run_df: DataFrame, rate: float, label: str) -> DataFrame:
    """Events of runs (start, length in samples) with both units; the end is inclusive."""
    end = F.col("start") + F.col("length") - 1
    return run_df.select("subject_id", F.col("start").cast("long").alias("start"), end.cast("long").alias("end"), (F.col("start") / rate).alias("start_sec"), (end / rate).alias("end_sec"), F.lit(label).alias("label"), F.lit("period").alias("kind"))


def point_events(df: DataFrame, index: str, rate: float, label: str) -> DataFrame:
    """Events of single samples."""
    i = F.col(index).cast("long")
    return df.select("subject_id", i.alias("start"), i.alias("end"), (i / rate).alias("start_sec"), (i / rate).alias("end_sec"), F.lit(label).alias("label"), F.lit("point").alias("kind"))


def row_median(df: DataFrame, channels: list[str], name: str = "median") -> DataFrame:
    """Median of the finite channels of a row."""
    vals = F.array_sort(F.filter(F.array(*channels), lambda x: x.isNotNull() & ~F.isnan(x)))
    df = df.withColumn("_v", vals)
    return df.withColumn(name, F.expr("CASE WHEN size(_v) > 0 THEN (get(_v, (size(_v) - 1) div 2) + get(_v, size(_v) div 2)) / 2 END")).drop("_v")


def infer_step(df: DataFrame, t: str, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """Median positive time step of each key."""
    d = df.withColumn("_d", F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t))).filter("_d > 0")
    return d.groupBy(*keys).agg(F.percentile("_d", F.lit(0.5)).alias("step"))


def dense_seconds(tracks: DataFrame, rows6: DataFrame, features: list[str]) -> DataFrame:
    """One row per second with its 6-s row's features held."""
    r = rows6.select("subject_id", F.col("slot").alias("_s"), *features)
    return tracks.withColumn("_s", F.floor(F.col("second") / 6)).join(r, ["subject_id", "_s"], "left").drop("_s")


def pick_examples(events: DataFrame, wanted: list[str], per_type: int = 1) -> DataFrame:
    """For each wanted label its first events; an exact match before ``<label>-O`` before any label that starts so."""
    out = None
    for w in wanted:
        rank = F.when(F.col("label") == w, 0).when(F.col("label") == w + "-O", 1).when(F.col("label").startswith(w), 2)
        x = events.withColumn("_r", rank).filter("_r IS NOT NULL").withColumn("wanted", F.lit(w))
        out = x if out is None else out.unionByName(x)
    w = Window.partitionBy("wanted").orderBy("_r", "subject_id", "start")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_type).drop("_r")
