"""Queries for quality rules, builders, selectors, experiments and exports (survey 2.2, 2.9-2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightgrid.operators import quality, runs
from nightgrid.sources.recordings import excerpt_json, union_datasets

from . import experiments
from .adapter import PAIRS, ROW, ROWS6, SIG, UNIT, pairs, rows6, sig
from .registry import query, r6
from .signals import model_frame


@query("p10_quality_rule", f"WITH {SIG} SELECT event_id, k / 100 >= 0.5 OR v / 100 >= 0.9 OR v >= 800 AS bad FROM sig")
def p10(spark, sf):
    s = sig(spark, sf).select("event_id", (F.col("k") / 100).alias("line"), (F.col("v") / 100).alias("corr"), F.col("v").alias("ptp"), F.lit(0.0).alias("flat"))
    return s.select("event_id", quality.bad_second("line", "corr", "ptp", "flat").alias("bad"))


@query("p11_unusable_epochs", f"WITH {SIG}, b AS (SELECT event_id, v < 20 AS a, k < 20 AS b, v < 5 AS c, v < 1 AND k < 1 AS f FROM sig) SELECT event_id, f AS l1, f OR (a AND b) AS l2, f OR (a AND b) OR c AS l3 FROM b")
def p11(spark, sf):
    b = sig(spark, sf).select("event_id", (F.col("v") < 20).alias("a"), (F.col("k") < 20).alias("b"), (F.col("v") < 5).alias("c"), ((F.col("v") < 1) & (F.col("k") < 1)).alias("f"))
    return b.select("event_id", *[quality.unusable([("a", "b")], ["c"], "f", n).alias(f"l{n}") for n in (1, 2, 3)])


@query("x1_event_builders", f"WITH {ROWS6}, y AS (SELECT *, slot - row_number() OVER (PARTITION BY subject_id, stage ORDER BY slot) AS g FROM rows6) SELECT subject_id, min(slot) AS start, max(slot) AS \"end\", min(slot) * 6.0 AS start_sec, max(slot) * 6.0 AS end_sec, 'rem' AS label, 'period' AS kind FROM y WHERE stage = 4 GROUP BY subject_id, g")
def x1(spark, sf):
    return quality.period_events(runs.runs(rows6(spark, sf), "stage", "slot", only=4), 1 / 6.0, "rem").withColumns({"start_sec": F.round("start_sec", 6), "end_sec": F.round("end_sec", 6)})


@query("x3_row_median", f"WITH {SIG} SELECT event_id, list_median([v, k, v - k]) AS median FROM sig".replace("list_median([v, k, v - k])", "round(list_aggregate([v, k, v - k], 'median'), 6)"))
def x3(spark, sf):
    s = sig(spark, sf).withColumn("d", F.col("v") - F.col("k"))
    return quality.row_median(s, ["v", "k", "d"]).select("event_id", r6("median"))


@query("x7_infer_step", f"WITH {SIG}, d AS (SELECT subject_id, t_us - lag(t_us) OVER (PARTITION BY subject_id ORDER BY t_us) AS d FROM sig) SELECT subject_id, median(d) AS step FROM d WHERE d > 0 GROUP BY 1")
def x7(spark, sf):
    return quality.infer_step(sig(spark, sf), "t_us")


@query("x12_row_extraction", f"WITH {SIG} SELECT event_id, CAST(round_even(t_us / {float(ROW)}, 0) AS BIGINT) AS slot, CASE WHEN stage BETWEEN 0 AND 4 THEN stage ELSE -1 END AS stage FROM sig")
def x12(spark, sf):
    return sig(spark, sf).select("event_id", F.rint(F.col("t_us") / float(ROW)).cast("long").alias("slot"), F.when(F.col("stage").between(0, 4), F.col("stage")).otherwise(-1).alias("stage"))


@query("x13_dense_seconds", f"WITH {ROWS6}, s AS (SELECT subject_id, slot * 6 + i AS second, slot FROM rows6, range(6) t(i)) SELECT s.subject_id, s.second, round(r.v, 6) AS v FROM s JOIN rows6 r USING (subject_id, slot)")
def x13(spark, sf):
    r = rows6(spark, sf)
    t = r.select("subject_id", F.explode(F.expr("sequence(slot * 6, slot * 6 + 5)")).alias("second"))
    return quality.dense_seconds(t, r, ["v"]).select("subject_id", "second", r6("v"))


@query("x27_fold_results", f"WITH {PAIRS} SELECT subject_id % 5 AS fold, count(*) AS n, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pairs GROUP BY 1")
def x27(spark, sf):
    return pairs(spark, sf).groupBy((F.col("subject_id") % 5).alias("fold")).agg(F.count("*").alias("n"), r6(F.avg((F.col("truth") == F.col("pred")).cast("double")), "accuracy"))


@query("x29_track_epoch_means", f"WITH {ROWS6} SELECT subject_id, slot // 5 AS epoch_index, round(avg(v), 6) AS v FROM rows6 GROUP BY 1, 2 HAVING count(*) = 5")
def x29(spark, sf):
    from nightgrid.operators.binning import block_reduce

    return block_reduce(rows6(spark, sf), "slot", 5, {"v": F.avg("v")}).select("subject_id", F.col("block").alias("epoch_index"), r6("v"))


@query("x31_pick_examples", f"WITH {SIG}, e AS (SELECT subject_id, event_id AS start, CASE stage WHEN 0 THEN 'APNEA-O' WHEN 1 THEN 'HYP' WHEN 2 THEN 'HYP-C' ELSE 'x' END AS label FROM sig), r AS (SELECT 'APNEA' AS wanted, *, CASE WHEN label = 'APNEA' THEN 0 WHEN label = 'APNEA-O' THEN 1 WHEN starts_with(label, 'APNEA') THEN 2 END AS r FROM e UNION ALL SELECT 'HYP', *, CASE WHEN label = 'HYP' THEN 0 WHEN label = 'HYP-O' THEN 1 WHEN starts_with(label, 'HYP') THEN 2 END FROM e), q AS (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY r, subject_id, start) AS rank FROM r WHERE r IS NOT NULL) SELECT wanted, subject_id, start, label, rank FROM q WHERE rank <= 3")
def x31(spark, sf):
    label = F.when(F.col("stage") == 0, "APNEA-O").when(F.col("stage") == 1, "HYP").when(F.col("stage") == 2, "HYP-C").otherwise("x")
    e = sig(spark, sf).select("subject_id", F.col("event_id").alias("start"), label.alias("label"))
    return quality.pick_examples(e, ["APNEA", "HYP"], 3)


@query("io19_union_datasets", f"WITH {SIG} SELECT subject_id, v, NULL AS k, 'a' AS dataset FROM sig WHERE stage = 0 UNION ALL SELECT subject_id, NULL, k, 'b' FROM sig WHERE stage = 1")
def io19(spark, sf):
    s = sig(spark, sf)
    return union_datasets({"a": s.filter("stage = 0").select("subject_id", "v", F.col("k").alias("x__eeg_c3")), "b": s.filter("stage = 1").select("subject_id", "k")})


@query("io23_excerpt_json")
def io23(spark, sf):
    return excerpt_json(sig(spark, sf), 0, 240 * UNIT, 10)


@query("m23_feature_scores", f"""WITH {SIG}, x AS (SELECT label, f, v, CASE WHEN stage = label THEN 1 ELSE 0 END AS y FROM (SELECT stage, 'v' AS f, v FROM sig UNION ALL SELECT stage, 'k', k FROM sig) u, (SELECT unnest([0, 1, 2, 3, 4]) AS label) l),
c AS (SELECT label, f, v, count(*) AS n, sum(y) AS p FROM x GROUP BY ALL), q AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY label, f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS r FROM c), z AS (SELECT label, f, sum(r * p) AS s, CAST(sum(p) AS DOUBLE) AS np, CAST(sum(n) - sum(p) AS DOUBLE) AS nn FROM q GROUP BY 1, 2)
SELECT label AS class, f AS feature, round(greatest((s - np * (np + 1) / 2) / (np * nn), 1 - (s - np * (np + 1) / 2) / (np * nn)), 6) AS separation FROM z""")
def m23(spark, sf):
    return experiments.auc_ranking(sig(spark, sf), ["v", "k"], "stage", [0, 1, 2, 3, 4]).select("class", "feature", r6("separation"))


@query("m15_stage_fit")
def m15(spark, sf):
    auc = experiments.stage_fit(model_frame(spark, sf), ["v", "k"], "stage", 4)
    return spark.createDataFrame([(4, round(auc, 6))], "stage int, auc double")


@query("t5_complexity_sweep")
def t5(spark, sf):
    return spark.createDataFrame(experiments.complexity_sweep(model_frame(spark, sf), ["v", "k"], "target", [0, 1], (2, 4), 3), "depth int, learned_values int, macro_f1 double")


@query("t11_expert_vote")
def t11(spark, sf):
    x = experiments.one_vs_rest(model_frame(spark, sf), ["v", "k"], "stage", [0, 1, 2])
    return x.withColumn("y_pred", experiments.vote(["expert_0", "expert_1", "expert_2"])).select("subject_id", "epoch_index", "stage", "y_pred")
