"""Normalisation, confusion-based scores, rank statistics and effect sizes, all as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binning import clean
from .rolling import rank_table

ALIASES = {"none": "none", "standard": "standard_global", "standard_global": "standard_global", "robust": "robust_global", "robust_global": "robust_global", "robust_by_subject": "robust_by_subject"}


def centre_and_scale(df: DataFrame, column: str, kind: str, keys: tuple[str, ...]) -> DataFrame:
    """M1, M2, M4: ``keys, _c, _s`` per group; a scale of zero or none is 1."""
    x = clean(column)
    if kind.startswith("standard"):
        c, s = F.avg(x), F.stddev_pop(x)
    else:
        c, s = F.percentile(x, F.lit(0.5)), F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(c.alias("_c"), s.alias("_s")).withColumn("_s", F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0))


def normalise(df: DataFrame, column: str, kind: str = "robust_by_subject", fit_on: DataFrame | None = None, subject: str = "subject_id") -> DataFrame:
    """M2: global statistics come from ``fit_on``; per-subject ones from the subject's own rows."""
    kind = ALIASES[kind]
    if kind == "none":
        return df
    if kind == "robust_by_subject":
        x = df.join(centre_and_scale(df, column, kind, (subject,)), subject, "left")
    else:
        x = df.crossJoin(F.broadcast(centre_and_scale(df if fit_on is None else fit_on, column, kind, ())))  # one row
    return x.withColumn(column, (clean(column) - F.coalesce("_c", F.lit(0.0))) / F.coalesce("_s", F.lit(1.0))).drop("_c", "_s")


def confusion(df: DataFrame, truth: str, pred: str, labels: list, keys: tuple[str, ...] = ()) -> DataFrame:
    """M8: ``keys, truth, pred, n`` for every pair of labels; pairs with other labels are ignored."""
    spark = df.sparkSession
    pairs = spark.createDataFrame([(a, b) for a in labels for b in labels], f"{truth} int, {pred} int")
    counts = df.filter(F.col(truth).isin(labels) & F.col(pred).isin(labels)).groupBy(*keys, truth, pred).agg(F.count("*").alias("n"))
    spine = pairs if not keys else df.select(*keys).distinct().crossJoin(F.broadcast(pairs))  # labels squared rows
    return spine.join(counts, [*keys, truth, pred], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_scores(df: DataFrame, truth: str, pred: str, labels: list, keys: tuple[str, ...] = ()) -> DataFrame:
    """M6, M7: per class tp, fp, fn, precision, recall, f1; 0 where undefined."""
    hit = df.filter(F.col(truth).isin(labels) & F.col(pred).isin(labels))
    both = hit.select(*keys, F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(pred)).cast("int").alias("h")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")))).alias("e")).select(*keys, "e.*")
    g = both.groupBy(*keys, "label").agg(F.sum("h").alias("tp"), (F.sum("p") - F.sum("h")).alias("fp"), (F.sum("t") - F.sum("h")).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    g = g.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return g.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def summary(df: DataFrame, truth: str, pred: str, labels: list, keys: tuple[str, ...] = ()) -> DataFrame:
    """M9: n, accuracy, macro F1 over all labels and kappa (NULL without rows, 0 if chance agreement is complete)."""
    hit = df.filter(F.col(truth).isin(labels) & F.col(pred).isin(labels))
    group = lambda d, *c: d.groupBy(*keys, *c)
    total = group(hit).agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"))
    f1 = group(class_scores(df, truth, pred, labels, keys)).agg((F.sum("f1") / len(labels)).alias("macro_f1"))
    a = group(hit, F.col(truth).alias("label")).agg(F.count("*").alias("nt"))
    b = group(hit, F.col(pred).alias("label")).agg(F.count("*").alias("np"))
    pe = a.join(b, [*keys, "label"]).groupBy(*keys).agg(F.sum(F.col("nt").cast("double") * F.col("np")).alias("_pe"))
    out = total.join(f1, list(keys)).join(pe, list(keys), "left") if keys else total.crossJoin(f1).crossJoin(pe)  # one row each
    chance = F.coalesce("_pe", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    kappa = F.when(F.col("n") > 0, F.when(chance >= 1, 0.0).otherwise((F.col("accuracy") - chance) / (1 - chance)))
    return out.withColumn("kappa", kappa).drop("_pe")


def cohens_d(value: Column, group: Column) -> Column:
    """(mean of true - mean of false) / pooled SD (ddof 1); 0 if the pooled variance is not positive, NULL if a side has < 2 rows."""
    a, b = F.when(group, value), F.when(~group, value)
    na, nb = F.count(a), F.count(b)
    pooled = ((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b)) / F.nullif(na + nb - 2, F.lit(0))
    return F.when((na < 2) | (nb < 2), None).otherwise(F.when(pooled > 0, (F.avg(a) - F.avg(b)) / F.sqrt(pooled)).otherwise(0.0))


def rank_auc(df: DataFrame, value: str, group: str, keys: tuple[str, ...]) -> DataFrame:
    """Area under the ROC curve by average ranks; NULL if a class is empty. ``group`` is 0/1.

    Ranks come from counts per distinct value, in buckets of values (see ``rank_table``).
    """
    x = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    pos = x.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.sum(F.col(group).cast("long")).alias("_p"))
    c = pos.join(rank_table(x, value, keys).withColumnRenamed("rank", "_r"), [*keys, value])
    g = c.groupBy(*keys).agg(F.sum(F.col("_r") * F.col("_p")).alias("_s"), F.sum("_p").alias("n_pos"), (F.sum("_n") - F.sum("_p")).alias("n_neg"))
    auc = F.try_divide(F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0, (F.col("n_pos") * F.col("n_neg")).cast("double"))
    return g.withColumn("auc", auc).drop("_s")


def group_effect(df: DataFrame, value: str, group: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Eta squared of ``group`` on ``value`` and the intraclass correlation from mean squares (mean group size)."""
    g = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*keys, group).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    # whole mean and squares from group moments
    t = g.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.count("*").alias("k"), F.sum(F.col("_n") * F.col("_m")).alias("_s"), F.sum(F.col("_n") * F.col("_m") * F.col("_m")).alias("_q"), F.sum(F.col("_n") * F.col("_v")).alias("_w")
    )
    ssb = F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / F.col("n"), F.lit(0.0))
    t = t.withColumn("_b", ssb).withColumn("eta2", F.try_divide(F.col("_b"), F.col("_b") + F.col("_w")))
    msb, msw = F.try_divide(F.col("_b"), (F.col("k") - 1).cast("double")), F.try_divide(F.col("_w"), (F.col("n") - F.col("k")).cast("double"))
    size = F.col("n") / F.col("k").cast("double")
    return t.withColumn("icc", F.try_divide(msb - msw, msb + (size - 1) * msw)).drop("_s", "_q", "_w", "_b")
