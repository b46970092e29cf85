"""counts and means per epoch of events that a stage is known for, from one-second tracks of a night, in SQL functions.

Thresholds are the night's own medians and scaled deviations; a night is the largest group. Seconds without a value count as no event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .binning import clean
from .rolling import MAD_SCALE, centred_jump

#: The one-second tracks that the markers are read from.
TRACKS = ("eog_high", "eog_low", "f_rel_delta", "c_log_power", "c_rel_delta", "c_rel_theta", "emg_log_rms", "o_rel_alpha")
EPOCH_SECONDS = 30


def fit_moments(y: str, a: str, b: str) -> list[Column]:
    """Aggregates that ``fitted`` needs for the least-squares fit of ``y`` on ``a``, ``b`` and a constant, from rows that hold all three."""
    whole = F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()
    y, a, b = (F.when(whole, F.col(c)) for c in (y, a, b))
    means = [F.avg(c).alias(n) for c, n in ((y, "_my"), (a, "_ma"), (b, "_mb"))]
    return [*means, F.var_pop(a).alias("_aa"), F.var_pop(b).alias("_bb"), F.covar_pop(a, b).alias("_ab"), F.covar_pop(a, y).alias("_ay"), F.covar_pop(b, y).alias("_by")]


def fitted(a: str, b: str) -> Column:
    """The fit at a row that has the moments beside it. Where ``a`` and ``b`` say the same, one of them makes it; where neither varies, the constant."""
    det = F.expr("_aa * _bb - _ab * _ab")
    both = det > 1e-10 * F.col("_aa") * F.col("_bb")
    by_a = F.when(both, F.expr("_ay * _bb - _by * _ab") / det).when(F.col("_aa") > 0, F.expr("_ay / _aa")).otherwise(0.0)
    by_b = F.when(both, F.expr("_by * _aa - _ay * _ab") / det).when((F.col("_aa") <= 0) & (F.col("_bb") > 0), F.expr("_by / _bb")).otherwise(0.0)
    return F.col("_my") + by_a * (F.col(a) - F.col("_ma")) + by_b * (F.col(b) - F.col("_mb"))


def epoch_markers(seconds: DataFrame, second: str = "second", keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """``keys, epoch_index`` and five markers: bursts of the eyes in low delta, jumps of central power in high delta, slow eye movements that
    delta and power do not explain, alpha against its level while the chin is tense, theta bursts in low muscle tone.

    ``seconds``: a row for each second of a night, with ``TRACKS``. An alpha level of 0 gives NULL. All medians and moments of a night come
    from one aggregation, the deviations from a second one, so the tracks are read a fixed number of times.
    """
    k = list(keys)
    x = centred_jump(seconds.select(*keys, second, *[clean(c).alias(c) for c in TRACKS]), second, "c_log_power", 15, 2.5, keys)
    middle = [F.median(c).alias("_mid_" + c) for c in ("eog_high", "c_rel_theta", "f_rel_delta", "c_rel_delta", "emg_log_rms")]
    x = x.join(x.groupBy(*keys).agg(*middle, *fit_moments("eog_low", "f_rel_delta", "c_log_power")), k)
    off = lambda c: F.col(c) - F.col("_mid_" + c)
    x = x.join(x.groupBy(*keys).agg(*[F.median(F.abs(off(c))).alias("_dev_" + c) for c in ("eog_high", "c_rel_theta")]), k)
    burst = lambda c: F.col(c) > F.col("_mid_" + c) + 2 * MAD_SCALE * F.col("_dev_" + c)
    epochs = x.groupBy(*keys, F.floor(F.col(second) / EPOCH_SECONDS).cast("long").alias("epoch_index")).agg(
        F.count_if(burst("eog_high") & (off("f_rel_delta") < 0)).alias("rem_eye_bursts"), F.count_if(F.col("jump") & (off("c_rel_delta") > 0)).alias("kcomplex_events"),
        F.avg(F.col("eog_low") - fitted("f_rel_delta", "c_log_power")).alias("slow_eye_movements"), F.avg("o_rel_alpha").alias("_alpha"), F.avg("emg_log_rms").alias("_chin"),
        F.count_if(burst("c_rel_theta") & (off("emg_log_rms") < 0)).alias("sawtooth_theta"),
    )
    w = Window.partitionBy(*keys)  # the epochs of one night
    epochs = epochs.withColumn("_tense", F.percentile("_chin", F.lit(0.75)).over(w))
    level = F.median(F.when(F.col("_chin") > F.col("_tense"), F.col("_alpha"))).over(w)
    out = epochs.withColumn("alpha_dropout", F.col("_alpha") / F.nullif(level, F.lit(0.0)))
    return out.select(*keys, "epoch_index", "rem_eye_bursts", "kcomplex_events", "slow_eye_movements", "alpha_dropout", "sawtooth_theta")


#: Parts of names that mark arrays which are no feature of a row.
NOT_FEATURES = ("indices", "width", "time_idx", "interval", "order", "agreement")


def array_feature(name: Column, samples: Column, points: Column) -> Column:
    """An array of numbers drawn to ``points`` values by straight lines between its ends; NULL for index-like names, for fewer than two
    numbers and for no points."""
    n, rows = F.size(samples), points.cast("int")

    def at(k: Column) -> Column:
        place = k * (n - 1) / F.greatest(rows - 1, F.lit(1))
        left = F.floor(place).cast("int")
        lo, hi = F.get(samples, left), F.get(samples, F.least(left + 1, n - 1))
        return lo + (place - left) * (hi - lo)

    fits = ~F.lower(name).rlike("|".join(NOT_FEATURES)) & (n >= 2) & (rows > 0)
    return F.when(fits, F.when(n == rows, samples).otherwise(F.transform(F.sequence(F.lit(0), rows - 1), at)))


def array_features(arrays: DataFrame, lengths: DataFrame, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """``keys, name, row, v`` of ``arrays`` (``keys, name, samples``) on the rows of ``lengths`` (``keys, rows``)."""
    x = arrays.join(lengths, list(keys))
    return x.select(*keys, "name", F.posexplode(array_feature(F.col("name"), F.col("samples"), F.col("rows"))).alias("row", "v"))
