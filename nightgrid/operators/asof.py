"""As-of operators: what stood last, next or nearest at a time, by one sort per subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_neighbours(probes: DataFrame, samples: DataFrame, t: str, value: str, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """Each probe with the sample at or before it (``prev_t, prev_v``) and the one at or after it (``next_t, next_v``)."""
    names = [c for c in probes.columns if c not in keys and c != t]
    a = probes.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_k"), *names, F.lit(None).cast("double").alias("_v"))
    b = samples.filter(F.col(value).isNotNull()).select(*keys, F.col(t).alias("_t"), F.lit(0).alias("_k"), *[F.lit(None).cast(probes.schema[n].dataType).alias(n) for n in names], F.col(value).cast("double").alias("_v"))
    u = a.unionByName(b)
    back = Window.partitionBy(*keys).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_t"), "_k").rowsBetween(Window.unboundedPreceding, 0)
    st = F.when(F.col("_k") == 0, F.col("_t"))
    u = u.withColumns({
        "prev_t": F.last(st, True).over(back), "prev_v": F.last("_v", True).over(back),
        "next_t": F.last(st, True).over(ahead), "next_v": F.last("_v", True).over(ahead),
    })
    return u.filter("_k = 1").select(*keys, F.col("_t").alias(t), *names, "prev_t", "prev_v", "next_t", "next_v")


def linear(probes: DataFrame, samples: DataFrame, t: str, value: str, keys: tuple[str, ...] = ("subject_id",), max_gap: int | None = None) -> DataFrame:
    """Linear interpolation between the neighbours; beyond the ends the end value; NULL if the nearest sample is too far."""
    x = with_neighbours(probes, samples, t, value, keys)
    span = (F.col("next_t") - F.col("prev_t")).cast("double")
    mid = F.col("prev_v") + (F.col("next_v") - F.col("prev_v")) * F.try_divide((F.col(t) - F.col("prev_t")).cast("double"), span)
    y = F.when(F.col("prev_t").isNull(), F.col("next_v")).when(F.col("next_t").isNull(), F.col("prev_v")).when(span == 0, F.col("prev_v")).otherwise(mid)
    if max_gap is not None:
        gap = F.least(F.col(t) - F.col("prev_t"), F.col("next_t") - F.col(t))
        y = F.when(gap <= max_gap, y)
    return x.withColumn(value, y)


def nearest(probes: DataFrame, samples: DataFrame, t: str, value: str, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """The value of the nearest sample (the earlier of two equally near), NULL outside the samples."""
    x = with_neighbours(probes, samples, t, value, keys)
    y = F.when(F.col(t) - F.col("prev_t") <= F.col("next_t") - F.col(t), F.col("prev_v")).otherwise(F.col("next_v"))
    return x.withColumn(value, F.when(F.col("prev_t").isNotNull() & F.col("next_t").isNotNull(), y))


def neighbour_mean(df: DataFrame, order: str, value: str, good: str, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """Rows that are not good take the mean of the nearest good rows before and after (one of them, if there is only one)."""
    w = Window.partitionBy(*keys).orderBy(order)
    ok = F.when(F.col(good), F.col(value))
    prev = F.last(ok, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    nxt = F.first(ok, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn("filled", F.when(F.col(good), F.col(value)).otherwise(F.coalesce((prev + nxt) / 2, prev, nxt)))


def fill_forward(df: DataFrame, order: str, value: str, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """Last known value, and before the first one the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("filled", F.coalesce(prev, nxt))
