"""Closed intervals per subject: overlap joins, painting on rows, windows.

Overlap joins are bucketed: an interval is listed in every time bucket that it touches, so the join is an equi-join on (subject, bucket)
and one long subject spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _bucketed(df: DataFrame, start: str, end: str, width: int, name: str = "_bucket") -> DataFrame:
    first, last = F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long")
    return df.filter(F.col(end) >= F.col(start)).withColumn(name, F.explode(F.sequence(first, last)))


def overlapping_ids(a: DataFrame, b: DataFrame, id_col: str, keys: tuple[str, ...] = ("subject_id",), bucket: int = 1 << 20) -> DataFrame:
    """Ids of intervals of ``a`` (id, start, end) that share at least a point with one of ``b`` (start, end)."""
    left = _bucketed(a.select(*keys, id_col, "start", "end"), "start", "end", bucket)
    right = _bucketed(b.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e")), "_s", "_e", bucket)
    hit = left.join(right, (left["start"] <= right["_e"]) & (left["end"] >= right["_s"]) & (left["_bucket"] == right["_bucket"]) & _same(left, right, keys), "left_semi")
    return hit.select(*keys, id_col).distinct()


def _same(left: DataFrame, right: DataFrame, keys: tuple[str, ...]):
    cond = left[keys[0]] == right[keys[0]]
    for k in keys[1:]:
        cond = cond & (left[k] == right[k])
    return cond


def overlap_semi(a: DataFrame, b: DataFrame, id_col: str, keys: tuple[str, ...] = ("subject_id",), bucket: int = 1 << 20) -> DataFrame:
    """Intervals of ``a`` that overlap one of ``b``."""
    return a.join(overlapping_ids(a, b, id_col, keys, bucket), [*keys, id_col], "left_semi")


def overlap_anti(a: DataFrame, b: DataFrame, id_col: str, keys: tuple[str, ...] = ("subject_id",), bucket: int = 1 << 20) -> DataFrame:
    """Intervals of ``a`` that overlap none of ``b``."""
    return a.join(overlapping_ids(a, b, id_col, keys, bucket), [*keys, id_col], "left_anti")


def in_window(events: DataFrame, lo, hi) -> DataFrame:
    """Events that touch the closed window."""
    return events.filter((F.col("end") >= lo) & (F.col("start") <= hi))


def event_rows(events: DataFrame, width: int, n_rows: DataFrame, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """``keys, row`` of every row that an event touches, clipped to the key's rows (``n_rows``: keys, n)."""
    x = events.join(n_rows, list(keys)).withColumn("_a", F.greatest(F.floor(F.col("start") / width), F.lit(0)).cast("long"))
    x = x.withColumn("_b", F.least(F.floor(F.col("end") / width), F.col("n") - 1).cast("long")).filter("_b >= _a")
    return x.withColumn("row", F.explode(F.expr("sequence(_a, _b)"))).drop("_a", "_b", "n")


def painted(events: DataFrame, code: str, order: str, width: int, n_rows: DataFrame, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """The code of each row; later events (by ``order``) paint over earlier ones, rows without one are 0."""
    hit = event_rows(events, width, n_rows, keys).groupBy(*keys, "row").agg(F.max_by(code, order).alias(code))
    spine = n_rows.select(*keys, F.explode(F.expr("sequence(0L, n - 1)")).alias("row"))
    return spine.join(hit, [*keys, "row"], "left").withColumn(code, F.coalesce(code, F.lit(0)))
