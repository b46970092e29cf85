"""Rolling statistics over row frames and over time frames (integer microseconds), and window builders on slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .binning import clean

MAD_SCALE = 1.4826


def by(order: str, keys: tuple[str, ...] = ("subject_id",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(order: str, n: int, keys: tuple[str, ...] = ("subject_id",)) -> WindowSpec:
    return by(order, keys).rowsBetween(-(n - 1), 0)


def rolling_median(value: str, w: WindowSpec) -> Column:
    """Exact median of the frame, any length down to one."""
    return F.percentile(value, F.lit(0.5)).over(w)


def rolling_corr(x: str, y: str, w: WindowSpec) -> Column:
    """Correlation from moments; variances are floored at 0, tiny products give NULL, the rest is held to [-1, 1]."""
    m = lambda e: F.avg(e).over(w)
    cov = m(F.col(x) * F.col(y)) - m(x) * m(y)
    var = lambda c: F.greatest(m(F.col(c) * F.col(c)) - m(c) * m(c), F.lit(0.0))
    denom = F.sqrt(var(x) * var(y))
    return F.when(denom > 1e-12, F.least(F.greatest(cov / denom, F.lit(-1.0)), F.lit(1.0)))


def guarded(agg: Column, value: str, w: WindowSpec, min_count: int) -> Column:
    """A window aggregate where at least ``min_count`` values are there."""
    return F.when(F.count(value).over(w) >= min_count, agg.over(w))


def closed_range(order_us: str, half_us: int, keys: tuple[str, ...] = ("subject_id",)) -> WindowSpec:
    """[t - h, t + h]."""
    return by(order_us, keys).rangeBetween(-half_us, half_us)


def half_open_range(order_us: str, half_us: int, keys: tuple[str, ...] = ("subject_id",)) -> WindowSpec:
    """[t - h, t + h)."""
    return by(order_us, keys).rangeBetween(-half_us, half_us - 1)


def at_grid(samples: DataFrame, grid: DataFrame, t: str, value: str, half_us: int, aggs: dict[str, Column], keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """Aggregates of the samples in [c - h, c + h) at every grid centre c, without a range join: grid rows ride along as probes."""
    a = samples.select(*keys, F.col(t).alias("_t"), F.col(value).cast("double").alias(value), F.lit(0).alias("_k"))
    b = grid.select(*keys, F.col(t).alias("_t"), F.lit(None).cast("double").alias(value), F.lit(1).alias("_k"))
    w = half_open_range("_t", half_us, keys)
    out = a.unionByName(b).withColumns({k: x.over(w) for k, x in aggs.items()})
    return out.filter("_k = 1").select(*keys, F.col("_t").alias(t), *aggs)


def lag_features(df: DataFrame, order: str, columns: list[str], lags: list[int], keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """Earlier values beside each row, as ``<column>.prev<lag>`` with a double underscore for the dot."""
    w = by(order, keys)
    return df.withColumns({f"{c}__prev{n}": F.lag(c, n).over(w) for c in columns for n in lags})


def centred_jump(df: DataFrame, order: str, value: str, half: int, k: float, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """Value above the centred median by ``k`` scaled MADs of the same frame, where that scale is positive."""
    w = by(order, keys).rowsBetween(-half, half)
    x = df.withColumn("_med", F.percentile(value, F.lit(0.5)).over(w)).withColumn("_all", F.collect_list(value).over(w))
    dev = F.expr(f"sort_array(transform(_all, x -> abs(x - _med)))")
    x = x.withColumn("_dev", dev)
    mad = F.expr("(get(_dev, (size(_dev) - 1) div 2) + get(_dev, size(_dev) div 2)) / 2")
    x = x.withColumn("_sd", F.lit(MAD_SCALE) * mad)
    return x.withColumn("jump", F.coalesce((F.col("_sd") > 0) & (F.col(value) > F.col("_med") + k * F.col("_sd")), F.lit(False))).drop("_med", "_all", "_dev", "_sd")


def robust_threshold(df: DataFrame, value: str, k: float, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """Value above its subject's median by ``k`` scaled MADs."""
    med = df.groupBy(*keys).agg(F.median(value).alias("_med"))
    x = df.join(med, list(keys))
    mad = x.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_med"))).alias("_mad"))
    return x.join(mad, list(keys)).withColumn("above", F.col(value) > F.col("_med") + k * MAD_SCALE * F.col("_mad")).drop("_med", "_mad")


def average_rank(value: str, keys: tuple[str, ...]) -> Column:
    """Rank with ties sharing their mean."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / F.lit(2.0)


def rank_table(df: DataFrame, value: str, keys: tuple[str, ...] = (), buckets: int = 64) -> DataFrame:
    """W27 for large groups: ``keys, value, count, rank`` (average rank) of every distinct value.

    Rows are counted per distinct value first. Distinct values are cut into buckets at approximate quantiles; totals before a bucket come
    from bucket sums, ranks inside it from one bucket's values, so no task orders a whole group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("count"))
    cuts = counts.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 1000).alias("c")).collect()[0]["c"] or []
    cuts = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    counts = counts.withColumn("_b", F.size(F.filter(cuts, lambda c: c < F.col(value).cast("double"))))
    sums = counts.groupBy(*keys, "_b").agg(F.sum("count").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")  # ``buckets`` rows a key
    inside = F.sum("count").over(Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    out = counts.join(sums, [*keys, "_b"]).withColumn("_in", F.coalesce(inside, F.lit(0)))
    return out.withColumn("rank", F.col("_before") + F.col("_in") + (F.col("count") + 1) / F.lit(2.0)).drop("_b", "_before", "_in")


def sliding_slots(df: DataFrame, slot: str, size: int, stride: int, aggs: dict[str, Column], keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """Aggregates of every ``size`` rows without a slot gap, from the first of each gapless stretch on, every ``stride`` rows."""
    w0 = by(slot, keys)
    x = df.withColumn("_new", F.coalesce((F.col(slot) - F.lag(slot).over(w0) != 1).cast("long"), F.lit(1)))
    x = x.withColumn("_seg", F.sum("_new").over(w0.rowsBetween(Window.unboundedPreceding, 0)))
    seg = Window.partitionBy(*keys, "_seg").orderBy(slot)
    frame = seg.rowsBetween(0, size - 1)
    x = x.withColumns({"_n": F.count("*").over(frame), "_at": F.row_number().over(seg)} | {k: a.over(frame) for k, a in aggs.items()})
    return x.filter((F.col("_n") == size) & ((F.col("_at") - 1) % stride == 0)).select(*keys, F.col(slot).alias("start_slot"), *aggs)


def block_mean_at(df: DataFrame, order: str, value: str, lo: int, hi: int, keys: tuple[str, ...] = ("subject_id",)) -> Column:
    """Mean of rows [c + lo, c + hi], clipped to the night."""
    return F.avg(clean(value)).over(by(order, keys).rowsBetween(lo, hi))


def flat_context(df: DataFrame, order: str, columns: list[str], radius: int, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """CW6: neighbours of each row as ``ctx_m2__<f>`` .. ``ctx_p2__<f>``."""
    w = by(order, keys)
    name = lambda n: f"ctx_{'m' if n < 0 else 'p'}{abs(n)}"
    return df.withColumns({f"{name(n)}__{c}": (F.lag(c, -n) if n < 0 else F.lead(c, n)).over(w) for n in range(-radius, radius + 1) for c in columns})


def centred_sequences(df: DataFrame, slot: str, features: list[str], radius: int, keys: tuple[str, ...] = ("subject_id",), history: int | None = None) -> DataFrame:
    """CW1, CW2: arrays of the gapless rows around each row (``history`` rows before, ``radius`` after); incomplete ones go."""
    before = radius if history is None else history
    w = by(slot, keys).rowsBetween(-before, radius)
    x = df.withColumns({"_lo": F.min(slot).over(w), "_hi": F.max(slot).over(w), "_n": F.count("*").over(w), "sequence": F.collect_list(F.array(*features)).over(w)})
    size = before + radius + 1
    return x.filter((F.col("_n") == size) & (F.col("_hi") - F.col("_lo") == size - 1)).drop("_lo", "_hi", "_n")


def context_mean(df: DataFrame, order: str, columns: list[str], radius: int, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """CW4: finite means over the neighbourhood."""
    w = by(order, keys).rowsBetween(-radius, radius)
    return df.withColumns({f"{c}__ctxmean": F.avg(clean(c)).over(w) for c in columns})
