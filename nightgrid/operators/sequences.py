"""Tensors of steps as array columns: nested epochs, fine steps, resampled windows, scaling, and the frames that models are fed with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .binning import clean, windowed_mode
from .rolling import by


def hierarchical(df: DataFrame, slot: str, label: str, features: list[str], history: int, current: int, future: int, steps: int, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """CW3: ``keys, slot, sequence array<epochs<steps<features>>>, label``: gapless windows of whole epochs around each aligned row.

    The label is the most frequent non-negative code of the current epochs (ties: the smallest); windows without one go.
    """
    n, now = (history + current + future) * steps, current * steps
    w = by(slot, keys)
    frame = w.rowsBetween(-history * steps, (current + future) * steps - 1)
    row = F.array(*[clean(f) for f in features])
    x = df.withColumns({"_n": F.count("*").over(frame), "_lo": F.min(slot).over(frame), "_hi": F.max(slot).over(frame), "_all": F.collect_list(row).over(frame), "_labels": F.collect_list(F.col(label).cast("int")).over(w.rowsBetween(0, now - 1))})
    x = x.filter((F.col("_n") == n) & (F.col("_hi") - F.col("_lo") == n - 1) & (F.col(slot) % steps == 0))
    x = x.withColumn("sequence", F.expr(f"transform(sequence(0, {n // steps - 1}), e -> slice(_all, 1 + e * {steps}, {steps}))"))
    modal = F.expr("""transform(array_sort(transform(array_distinct(filter(_labels, c -> c >= 0)), c -> struct(-size(filter(_labels, d -> d = c)) AS n, c AS c))), x -> x.c)""")
    return x.withColumn("_modal", F.get(modal, F.lit(0))).filter("_modal IS NOT NULL").select(*keys, slot, "sequence", F.col("_modal").alias(label))


def flattened(sequence: str) -> Column:
    """CW5: a nested tensor as one array, steps first."""
    return F.flatten(sequence)


def sequences(df: DataFrame, mode: str, **options) -> DataFrame:
    """``centered`` (CW1), ``epoch_aligned`` (CW2) or ``hierarchical`` (CW3)."""
    from .rolling import centred_sequences

    if mode == "hierarchical":
        return hierarchical(df, **options)
    if mode == "centered":
        return centred_sequences(df, **options)
    if mode == "epoch_aligned":
        steps, label = options.pop("steps"), options.pop("label")
        return centred_sequences(df, **options).filter((F.col(options["slot"]) % steps == 0) & (F.col(label) >= 0))
    raise ValueError(f"no sequence mode {mode}")


def fine_steps(seconds: DataFrame, epochs: DataFrame, values: list[str], context: int = 2, width: int = 6, per_epoch: int = 5, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """CW9: ``keys, epoch_index, steps``: means of ``width`` seconds over the epoch and its neighbours, NULL past the night's ends; steps first."""
    rows = seconds.groupBy(*keys, F.floor(F.col("second") / width).cast("long").alias("_r")).agg(F.array(*[F.avg(clean(v)) for v in values]).alias("_v"))
    n = (2 * context + 1) * per_epoch
    want = epochs.select(*keys, "epoch_index", F.posexplode(F.expr(f"sequence((epoch_index - {context}) * {per_epoch}, (epoch_index - {context}) * {per_epoch} + {n - 1})")).alias("_k", "_r"))
    none = F.array(*[F.lit(None).cast("double") for _ in values])
    got = want.join(rows, [*keys, "_r"], "left").groupBy(*keys, "epoch_index").agg(F.array_sort(F.collect_list(F.struct("_k", F.coalesce("_v", none).alias("v")))).alias("_s"))
    return got.select(*keys, "epoch_index", F.flatten(F.transform("_s", lambda x: x["v"])).alias("steps"))


def robust_tensor(df: DataFrame, fit: DataFrame, channels: list[str]) -> DataFrame:
    """(value - median) / interquartile range of ``fit`` per channel; a range under 1e-6 counts as 1; NULL becomes 0."""
    q = fit.agg(*[F.percentile(clean(c), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in channels]).collect()[0]  # one row
    out = {}
    for c in channels:
        lo, mid, hi = q[c] if q[c] is not None else (0.0, 0.0, 0.0)
        out[c] = F.coalesce((clean(c) - mid) / (hi - lo if hi - lo >= 1e-6 else 1.0), F.lit(0.0))
    return df.withColumns(out)


def aligned_probabilities(proba: str, from_classes: list[int], to_classes: list[int]) -> Column:
    """class probabilities in another order, absent ones 0, rows summing to 1 where anything is left."""
    x = F.array(*[F.coalesce(F.get(proba, F.lit(from_classes.index(c))), F.lit(0.0)) if c in from_classes else F.lit(0.0) for c in to_classes])
    total = F.aggregate(x, F.lit(0.0), lambda a, p: a + p)
    return F.when(total > 0, F.transform(x, lambda p: p / total)).otherwise(x)


def resampled_window(samples: str, fs: float, start: Column, seconds: float, points: int) -> Column:
    """``points`` values at bin centres of [start, start + seconds) of an array of samples, by straight lines; broken samples (no number, or no end to it) are bridged
    first; NULL with fewer than two samples."""
    s = F.greatest(F.floor(start * fs), F.lit(0)).cast("int")
    e = F.least(F.ceil((start + seconds) * fs), F.size(samples)).cast("int")
    cut = F.slice(samples, s + 1, F.greatest(e - s, F.lit(0)))
    good = F.filter(F.transform(cut, lambda v, i: F.struct(i.alias("i"), F.when(F.abs(v) < float("inf"), v).alias("v"))), lambda x: x["v"].isNotNull())

    def at(g: Column, place: Column) -> Column:
        left = F.element_at(F.filter(g, lambda p: p["i"] <= place), -1)
        right = F.get(F.filter(g, lambda p: p["i"] > place), F.lit(0))
        line = left["v"] + (right["v"] - left["v"]) * (place - left["i"]) / (right["i"] - left["i"])
        return F.when(left.isNull(), right["v"]).when(right.isNull(), left["v"]).otherwise(line)

    places = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: (start + (k + 0.5) * (seconds / points)) * fs - s)
    return F.when((e - s >= 2) & (F.size(good) >= 2), F.transform(places, lambda p: at(good, p)))


def second_track(epochs: DataFrame, stage: str = "stage", epoch: int = 30, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """IO13: the epoch codes held for each of their seconds."""
    return epochs.select(*keys, F.explode(F.expr(f"sequence(epoch_index * {epoch}, epoch_index * {epoch} + {epoch - 1})")).alias("second"), stage)


def whole_second_events(events: DataFrame) -> DataFrame:
    """IO13: events in whole seconds, from the floor of the start to the ceiling of the end less one."""
    return events.withColumns({"start": F.floor("start").cast("long"), "end": (F.ceil("end") - 1).cast("long")})


def hypnogram(lines: DataFrame, lengths: DataFrame, codes: Column, epoch: int = 30, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """IO14: whole numbers in order, one or several a line, mapped (``codes``, of ``code``), cut or filled with -1 to the recording's length. What is no whole number is passed over."""
    x = lines.select(*keys, "line_no", F.posexplode(F.split("line", r"\s+")).alias("at", "word")).filter(F.col("word").rlike("^-?[0-9]+$"))
    x = x.withColumn("code", F.col("word").try_cast("int"))
    x = x.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("line_no", "at")) - 1).alias("epoch_index"), codes.alias("stage"))
    spine = lengths.filter(F.col("length") >= epoch).select(*keys, F.explode(F.expr(f"sequence(0, cast(floor(length / {epoch}) AS int) - 1)")).alias("epoch_index"))
    return spine.join(x, [*keys, "epoch_index"], "left").withColumn("stage", F.coalesce("stage", F.lit(-1)))


def experiment_frame(df: DataFrame, features: list[str], target: str, stage_target: bool = True) -> DataFrame:
    """P5: subject, row, finite features and target; no rows where a column is missing; a stage target is 0 at least."""
    if any(c not in df.columns for c in [*features, target]):
        return df.limit(0)
    x = df.withColumns({f: clean(f) for f in features}).dropna(subset=[*features, target])
    return x.filter(F.col(target) >= 0) if stage_target else x


def finite_group(df: DataFrame, value: str, group: str) -> DataFrame:
    """Finite values with a group label."""
    return df.withColumn(value, clean(value)).dropna(subset=[value, group])


def night_bounds(df: DataFrame, order: str, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """Each row's place in its night and the night's size."""
    return df.withColumns({"place": F.row_number().over(by(order, keys)) - 1, "size": F.count("*").over(Window.partitionBy(*keys))})


def target_row(df: DataFrame, slot: str, fraction: str, anchors: list[str], size: int, anchor_seconds: float, keys: tuple[str, ...] = ("subject_id",), seconds_per_row: int = 1) -> DataFrame:
    """Per block of ``size`` rows: event seconds, their share of the block, and the codes of the row at ``anchor_seconds`` (the last row of a block that ends before); 0 where a code is missing."""
    block = F.floor(F.col(slot) / size).cast("long")
    of = Window.partitionBy(*keys, "block")
    anchor = max(int(round(anchor_seconds / max(seconds_per_row, 1))), 0)
    x = df.withColumn("block", block).withColumn("_at", (F.row_number().over(of.orderBy(slot)) - 1) == F.least(F.lit(anchor), F.count("*").over(of) - 1))
    f = F.sum(F.coalesce(F.when(F.abs(clean(fraction)) < float("inf"), clean(fraction)), F.lit(0.0))) * seconds_per_row
    code = lambda c: F.coalesce(F.max(F.when(F.col("_at"), F.rint(F.col(c).cast("double")))), F.lit(0.0)).cast("int").alias(c)
    return x.groupBy(*keys, "block").agg(f.alias("event_seconds"), (f / (F.count("*") * seconds_per_row)).alias("event_fraction"), *map(code, anchors))


def enriched(
    df: DataFrame, order: str, codes: list[str], events: DataFrame, lags: list[int], values: list[str], width: int, keys: tuple[str, ...] = ("subject_id",), tracks: dict[str, tuple[DataFrame, dict[int, str]]] | None = None, kinds: list[str] | None = None
) -> DataFrame:
    """A feature table with what truth tracks and events say about each row, and lagged values.

    ``tracks``: per name a second-by-second track (keys, ``second``, ``code``) and its classes; a row gets the most frequent code of its ``width`` seconds as ``label__name`` and the class as ``label__name__class``
    (-1 and "unknown" where it has none). ``kinds``: types of events (column ``kind``); a row gets the number that overlap it as ``event__kind``, and ``event__any``.
    """
    from .labels import mapped
    from .rolling import lag_features

    own = events if kinds is None else events.filter(F.col("kind").isin(kinds))
    touched = own.select(*keys, *(["kind"] if kinds is not None else []), F.explode(F.expr(f"sequence(start div {width}, `end` div {width})")).alias(order))
    counts = [F.count("*").alias("events")] + [F.count_if(F.col("kind") == k).alias(f"event__{k}") for k in kinds or []]
    x = df.join(touched.groupBy(*keys, order).agg(*counts), [*keys, order], "left")
    x = x.withColumns({c: F.coalesce(c, F.lit(0)) for c in ["events", *(f"event__{k}" for k in kinds or [])]})
    if kinds is not None:
        x = x.withColumn("event__any", F.col("events") > 0)
    for name, (track, classes) in (tracks or {}).items():
        rows = track.withColumn(order, F.floor(F.col("second") / width).cast("long"))
        mode = windowed_mode(rows.filter(F.col("code") >= 0), "code", [*keys, order]).withColumnRenamed("code", f"label__{name}")
        x = x.join(mode, [*keys, order], "left").withColumn(f"label__{name}", F.coalesce(f"label__{name}", F.lit(-1)))
        x = x.withColumn(f"label__{name}__class", mapped(F.col(f"label__{name}"), classes, "unknown"))
    return lag_features(x.withColumns({c + "__known": F.col(c) >= 0 for c in codes}), order, values, lags, keys)


def union_scores(tables: dict[str, DataFrame], recode: dict[int, int], truth: str, pred: str) -> DataFrame:
    """Result sets under each other with both codings of their classes."""
    from .labels import mapped

    out = None
    for name, t in sorted(tables.items()):
        x = t.select(F.lit(name).alias("model"), F.col(truth).alias("truth"), F.col(pred).alias("pred"))
        out = x if out is None else out.unionByName(x)
    return out.withColumns({"truth4": mapped(F.col("truth"), recode, -1), "pred4": mapped(F.col("pred"), recode, -1)})


def consolidated(tracks: DataFrame) -> DataFrame:
    """Names of the signals of each algorithm."""
    return tracks.groupBy("algo").agg(F.array_sort(F.collect_set("signal")).alias("signals"))


def broadcast_scalars(df: DataFrame, scalars: dict[str, object]) -> DataFrame:
    """IO18: single values beside every row of the longest column."""
    return df.withColumns({k: F.lit(v) for k, v in scalars.items()})


def clipped_windows(df: DataFrame, order: str, value: str, before: int, after: int, limit: float = 6.0, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """Robust z of the night (median and scaled MAD), held to +-``limit``, NULL as 0, as windows around each row."""
    med = df.groupBy(*keys).agg(F.median(value).alias("_m"))
    x = df.join(med, list(keys))
    mad = x.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_m"))).alias("_d"))
    z = (F.col(value) - F.col("_m")) / F.when(F.col("_d") > 0, 1.4826 * F.col("_d")).otherwise(1.0)
    x = x.join(mad, list(keys)).withColumn("_z", F.coalesce(F.least(F.greatest(z, F.lit(-limit)), F.lit(limit)), F.lit(0.0)))
    return x.withColumn("window", F.collect_list("_z").over(by(order, keys).rowsBetween(-before, after))).drop("_m", "_d", "_z")


def epoch_labels(df: DataFrame, slot: str, label: str, size: int = 5, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """The labelled epochs without features."""
    block = F.floor(F.col(slot) / size).cast("long")
    x = df.withColumn("epoch_index", block)
    full = x.groupBy(*keys, "epoch_index").agg(F.count("*").alias("_n")).filter(F.col("_n") == size).drop("_n")
    return full.join(windowed_mode(x.filter(F.col(label) >= 0), label, [*keys, "epoch_index"]), [*keys, "epoch_index"])
