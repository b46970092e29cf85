"""Queries for boosted trees and the window model (survey T1, T3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightgrid.operators import binning

from . import boosting, selection
from .adapter import rows6
from .registry import query, r6
from .signals import EPOCHS

WHOLE = f"{EPOCHS}, fr AS (SELECT subject_id, least(floor(round(v, 9)), 200) AS a, least(floor(round(k, 9)), 200) AS b, stage AS y FROM ep WHERE v IS NOT NULL AND k IS NOT NULL)"


def epochs(spark, sf):
    return binning.centred_epochs(rows6(spark, sf), "slot", "stage", ["v", "k"])


def whole_numbers(spark, sf):
    """Epochs with features of few values, so that bins are values and SQL can name them. A mean is a whole number to nine places: its last bits are the order's in which it was summed up."""
    x = epochs(spark, sf).filter("v IS NOT NULL AND k IS NOT NULL")
    whole = lambda c: F.least(F.floor(F.round(c, 9)), F.lit(200)).cast("double")
    return x.select("subject_id", "epoch_index", whole("v").alias("a"), whole("k").alias("b"), F.col("stage").alias("y"))


@query("t1_split_gains", f"""{WHOLE}, pr AS (SELECT y AS c, count(*) / sum(count(*)) OVER () AS p FROM fr GROUP BY 1), lg AS (SELECT 'a' AS feature, a AS x, y FROM fr UNION ALL SELECT 'b', b, y FROM fr),
hs AS (SELECT c, feature, x, sum(p - CASE WHEN y = c THEN 1 ELSE 0 END) AS g, sum(p * (1 - p)) AS h, count(*) AS n FROM lg, pr GROUP BY 1, 2, 3),
cu AS (SELECT *, sum(g) OVER w AS ag, sum(h) OVER w AS ah, sum(n) OVER w AS an, sum(g) OVER e AS tg, sum(h) OVER e AS th, sum(n) OVER e AS tn FROM hs WINDOW w AS (PARTITION BY c, feature ORDER BY x), e AS (PARTITION BY c, feature))
SELECT c AS "class", feature, CAST(x AS DOUBLE) AS cut, round(ag * ag / ah + (tg - ag) * (tg - ag) / (th - ah) - tg * tg / th, 4) AS gain FROM cu WHERE an >= 20 AND tn - an >= 20 AND ah >= 0.001 AND th - ah >= 0.001""")
def split_gains(spark, sf):
    """What each split of a first tree's root would gain, for every class, feature and value."""
    return boosting.root_gains(whole_numbers(spark, sf), ["a", "b"], "y").select("class", "feature", "cut", F.round("gain", 4).alias("gain"))


@query("t1_boosted_out_of_fold")
def out_of_fold(spark, sf):
    """Boosted trees of five classes, every row by the model that has not seen its subject."""
    p = boosting.out_of_fold(epochs(spark, sf), ["v", "k"], "stage", k=3, rounds=6, depth=3, keys=["subject_id", "epoch_index", "stage"])
    return p.select("subject_id", "epoch_index", "stage", "fold", "y_pred", F.transform("proba", lambda x: F.round(x, 6)).alias("proba"))


STEPS = [(f"{s}__{t:+d}", s, t) for t in range(-10, 15) for s in ("v", "k")]


@query("t3_window_frame", f"""{EPOCHS}, w AS (SELECT subject_id, slot, {", ".join(f'{"lag" if t < 0 else "lead"}({s}, {abs(t)}) OVER o AS "{n}"' for n, s, t in STEPS)} FROM rows6 WINDOW o AS (PARTITION BY subject_id ORDER BY slot))
SELECT subject_id, epoch_index, stage, {", ".join(f'round("{n}", 6) AS "{n}"' for n, _, _ in STEPS[::7])} FROM ep JOIN w ON w.subject_id = ep.subject_id AND w.slot = ep.epoch_index * 5""".replace("SELECT subject_id, epoch_index, stage, round", "SELECT ep.subject_id, epoch_index, stage, round"))
def window_frame(spark, sf):
    x, _ = boosting.window_frame(rows6(spark, sf), epochs(spark, sf).select("subject_id", "epoch_index", "stage"), ["v", "k"])
    return x.select("subject_id", "epoch_index", "stage", *[r6(F.col(f"`{n}`"), n) for n, _, _ in STEPS[::7]])


@query("t3_window_model")
def window_model(spark, sf):
    """The window model: boosted trees on windows of five epochs, then smoothing by the transitions of the subjects in training."""
    p = boosting.window_model(rows6(spark, sf), epochs(spark, sf), ["v", "k"], "stage", k=3, rounds=6, depth=3)
    r = lambda c: F.transform(c, lambda x: F.round(x, 6)).alias(c)
    return p.select("subject_id", "epoch_index", "stage", "fold", "y_pred", r("proba"), r("smoothed"), "decoded")


FEATURES = ["v", "k", "vk", "late"]


def selection_frame(spark, sf):
    x = epochs(spark, sf).filter("v IS NOT NULL AND k IS NOT NULL")
    return x.select("subject_id", "stage", "v", "k", (F.col("v") * F.col("k")).alias("vk"), (F.col("epoch_index") % 4).cast("double").alias("late"))


@query("m25_moments", f"""{EPOCHS}, x AS (SELECT subject_id, stage, v, k FROM ep WHERE v IS NOT NULL AND k IS NOT NULL), q AS (SELECT subject_id, quantile_cont(v, 0.25) AS v1, median(v) AS v2, quantile_cont(v, 0.75) AS v3, quantile_cont(k, 0.25) AS k1, median(k) AS k2, quantile_cont(k, 0.75) AS k3 FROM x GROUP BY 1),
z AS (SELECT stage, (v - v2) / CASE WHEN v3 > v1 THEN v3 - v1 ELSE 1 END AS v, (k - k2) / CASE WHEN k3 > k1 THEN k3 - k1 ELSE 1 END AS k FROM x JOIN q USING (subject_id)) SELECT stage, count(*) AS n, round(sum(v), 4) AS sum_v, round(sum(k), 4) AS sum_k, round(sum(sum(v * k)) OVER (), 4) AS vk, round(sum(sum(v * v)) OVER (), 4) AS vv FROM z GROUP BY 1""")
def moments(spark, sf):
    """What the left-out models are made of: rows and sums by class, and products."""
    rows = selection.scaled_rows(selection_frame(spark, sf), ["v", "k"], "stage", [0, 1, 2, 3, 4])
    m = selection.moments(rows, 2, 5)
    r = lambda x: round(float(x), 4)
    return spark.createDataFrame([(c, int(m.n[c]), r(m.sums[c, 0]), r(m.sums[c, 1]), r(m.products[0, 1]), r(m.products[0, 0])) for c in range(5) if m.n[c]], "stage int, n long, sum_v double, sum_k double, vk double, vv double")


@query("m25_left_out_selection")
def left_out(spark, sf):
    """A greedy selection with each subject left out in turn."""
    out = selection.select_features(selection_frame(spark, sf), FEATURES, "stage", most=3, least_pct=-100.0)
    return out.select("step", "added_feature", F.round("cumulative_macro_f1", 8).alias("cumulative_macro_f1"), F.round("delta_f1", 8).alias("delta_f1"), "mode")


@query("m25_baseline", f"""{EPOCHS}, cl AS (SELECT stage, count(*) AS n FROM ep WHERE v IS NOT NULL AND k IS NOT NULL GROUP BY 1) SELECT 0 AS step, '__baseline__' AS added_feature, round(2.0 * max(n) / (max(n) + sum(n)) / count(*), 8) AS cumulative_macro_f1 FROM cl""")
def baseline(spark, sf):
    out = selection.select_features(selection_frame(spark, sf), FEATURES, "stage", "auc_rank", most=1)
    return out.filter("step = 0").select("step", "added_feature", F.round("cumulative_macro_f1", 8).alias("cumulative_macro_f1"))
