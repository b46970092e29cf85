"""Time bins, block reducers and spines. Time is integer microseconds (``t_us``), so bins have no rounding drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Edges are filled at most this many rows-worth of seconds, counted in units of the engine's second.
EDGE_SECONDS = 30


def clean(c: str | Column) -> Column:
    """NaN and infinities become NULL."""
    x = F.col(c) if isinstance(c, str) else c
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def time_bin(df: DataFrame, width_us: int, value: str = "v", reducer: str = "mean", keys: tuple[str, ...] = ("subject_id",), t: str = "t_us") -> DataFrame:
    """``keys, row, value``: mean of finite values per row, or the maximum for masks and classes."""
    x = clean(value)
    agg = F.max(x) if reducer == "max" else F.avg(x)
    return df.groupBy(*keys, F.floor(F.col(t) / width_us).cast("long").alias("row")).agg(agg.alias(value))


def row_spine(df: DataFrame, n_rows: Column, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """Every row 0..n-1 of every key; ``n_rows`` is an aggregate over the key."""
    return df.groupBy(*keys).agg(n_rows.cast("long").alias("n")).filter("n > 0").select(*keys, F.explode(F.expr("sequence(0L, n - 1)")).alias("row"))


def binned_on_spine(df: DataFrame, width_us: int, unit_us: int, value: str = "v", reducer: str = "mean", keys: tuple[str, ...] = ("subject_id",), t: str = "t_us") -> DataFrame:
    """A1: binned rows on the full spine; in mean mode the rows within 30 units of the covered range take its end values."""
    bins = time_bin(df, width_us, value, reducer, keys, t)
    out = row_spine(df, F.ceil((F.max(t) + 1) / width_us), keys).join(bins, [*keys, "row"], "left")
    if reducer == "max":
        return out
    reach = EDGE_SECONDS * unit_us // width_us
    w = Window.partitionBy(*keys)
    covered = F.when(F.col(value).isNotNull(), F.col("row"))
    ends = out.withColumns({"_lo": F.min(covered).over(w), "_hi": F.max(covered).over(w)})
    at = lambda end: F.max(F.when(F.col("row") == F.col(end), F.col(value))).over(w)
    ends = ends.withColumns({"_first": at("_lo"), "_last": at("_hi")})
    filled = (
        F.when((F.col("row") < F.col("_lo")) & (F.col("row") >= F.col("_lo") - reach), F.col("_first"))
        .when((F.col("row") > F.col("_hi")) & (F.col("row") <= F.col("_hi") + reach), F.col("_last"))
        .otherwise(F.col(value))
    )
    return ends.withColumn(value, filled).drop("_lo", "_hi", "_first", "_last")


def windowed_mode(df: DataFrame, code: str, keys: list[str]) -> DataFrame:
    """A2: most frequent rounded code; the smallest wins ties. Counts first, so a hot key is combined before the shuffle."""
    n = df.filter(F.col(code).isNotNull()).groupBy(*keys, F.rint(F.col(code).cast("double")).cast("int").alias(code)).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.max_by(code, F.struct("_n", -F.col(code))).alias(code))


def block_reduce(df: DataFrame, index: str, size: int, aggs: dict[str, Column], keys: tuple[str, ...] = ("subject_id",), full_only: bool = True) -> DataFrame:
    """Aggregates per block of ``size`` samples; a trailing part of a block is dropped unless asked for."""
    g = df.groupBy(*keys, F.floor(F.col(index) / size).cast("long").alias("block")).agg(F.count("*").alias("_n"), *[a.alias(k) for k, a in aggs.items()])
    return (g.filter(F.col("_n") == size) if full_only else g).drop("_n")


def resample_linear(df: DataFrame, index: str, value: str, n_out: int, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """A4: ``n_out`` values at equal steps between the first and the last sample, by linear interpolation."""
    w = Window.partitionBy(*keys).orderBy(index)
    nxt = df.select(*keys, F.col(index).alias("_i"), F.col(value).alias("_a"), F.lead(value).over(w).alias("_b"))
    grid = df.groupBy(*keys).agg(F.max(index).alias("_m")).select(*keys, "_m", F.explode(F.sequence(F.lit(0), F.lit(n_out - 1))).alias("j"))
    pos = F.col("j") * F.col("_m") / F.lit(max(n_out - 1, 1)).cast("double")
    grid = grid.withColumn("_x", pos).withColumn("_i", F.floor("_x").cast("long"))
    frac = F.col("_x") - F.col("_i")
    joined = grid.join(nxt, [*keys, "_i"], "left")
    return joined.select(*keys, "j", (F.col("_a") + F.when(frac > 0, frac * (F.col("_b") - F.col("_a"))).otherwise(0.0)).alias(value))


def centred_epochs(df: DataFrame, slot: str, label: str, features: list[str], size: int = 5, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """Blocks of ``size`` consecutive rows *by position*, kept if the first slot is aligned and the slots have no gap.

    Label: the most frequent non-negative code (ties: the smallest); blocks without one go. Features: finite means.
    """
    w = Window.partitionBy(*keys).orderBy(slot)
    x = df.withColumn("_b", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    means = [F.avg(clean(f)).alias(f) for f in features]
    g = x.groupBy(*keys, "_b").agg(F.count("*").alias("_n"), F.min(slot).alias("_lo"), F.max(slot).alias("_hi"), *means)
    g = g.filter((F.col("_n") == size) & (F.col("_lo") % size == 0) & (F.col("_hi") - F.col("_lo") == size - 1))
    lab = windowed_mode(x.filter(F.col(label) >= 0), label, [*keys, "_b"])
    return g.join(lab, [*keys, "_b"]).select(*keys, (F.col("_lo") / size).cast("long").alias("epoch_index"), *features, label)
