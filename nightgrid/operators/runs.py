"""Runs of equal values along an order: gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_island(df: DataFrame, value: str, order: str, keys: tuple[str, ...] = ("subject_id",), consecutive: bool = False) -> DataFrame:
    """Number of the run that each row is in; with ``consecutive`` a gap in ``order`` ends a run as well."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(w))
    if consecutive:
        new = new | (F.col(order) - F.lag(order).over(w) != 1)
    first = F.row_number().over(w) == 1
    run = F.sum((new | first).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("island", run)


def runs(df: DataFrame, value: str, order: str, keys: tuple[str, ...] = ("subject_id",), only=None, consecutive: bool = False) -> DataFrame:
    """``keys, value, start, length`` of runs; ``only`` keeps runs of one value."""
    g = with_island(df, value, order, keys, consecutive).groupBy(*keys, "island", value).agg(F.min(order).alias("start"), F.count("*").alias("length"))
    g = g.drop("island")
    return g if only is None else g.filter(F.col(value) == F.lit(only))


def expand_runs(run_df: DataFrame, n_rows: DataFrame, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """``keys, row`` of rows that lie in a run, clipped to ``0..n-1`` of each key (``n_rows``: keys, n)."""
    clipped = run_df.join(n_rows, list(keys)).withColumn("_a", F.greatest("start", F.lit(0))).withColumn("_b", F.least(F.col("start") + F.col("length"), "n") - 1)
    return clipped.filter("_b >= _a").select(*keys, F.explode(F.expr("sequence(_a, _b)")).alias("row")).distinct()


def run_length_per_row(df: DataFrame, value: str, order: str, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """The length of the run that each row belongs to."""
    x = with_island(df, value, order, keys)
    return x.withColumn("run_length", F.count("*").over(Window.partitionBy(*keys, "island"))).drop("island")


def longest_runs(run_df: DataFrame, k: int, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """The ``k`` longest runs, earlier ones first among equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc("length"), "start")
    return run_df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
