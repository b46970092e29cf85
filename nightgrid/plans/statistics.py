"""Queries for labels, normalisation, scores, effect sizes, context and decoders (survey 2.1, 2.9, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.operators import decoders, labels, rolling, runs, stats

from .adapter import PAIRS, ROWS6, SIG, UNIT, pairs, rows6, sig, table
from .registry import query, r6

LABELS = [0, 1, 2, 3, 4]
def W():  # noqa: N802
    return Window.partitionBy("subject_id").orderBy("slot")


# --- labels ------------------------------------------------------------------------------------------------------


@query("io9_stage_lines", f"WITH {SIG}, l AS (SELECT subject_id, stage, row_number() OVER (PARTITION BY subject_id ORDER BY t_us) - 1 AS e FROM sig) SELECT subject_id, e * 30 + s AS second, CASE stage WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE -1 END AS stage FROM l, range(30) t(s)")
def io9(spark, sf):
    lines = sig(spark, sf).select("subject_id", F.col("t_us").alias("line_no"), F.format_string(" %d ", "stage").alias("line"))
    return labels.stage_seconds(lines)


RESP = f"{SIG}, l AS (SELECT subject_id, t_us // 1000000 % 86400 AS start, k, CASE stage WHEN 0 THEN 'HYP-C' WHEN 1 THEN 'APNEA-O' WHEN 2 THEN 'APNEA-M' ELSE 'POSS' END AS label, event_id FROM sig)"


def resp_lines(spark, sf):
    s = sig(spark, sf).withColumn("s", F.floor(F.col("t_us") / 1000000) % 86400)
    clock = F.format_string("%02d:%02d:%02d", F.floor(F.col("s") / 3600), F.floor(F.col("s") / 60) % 60, F.col("s") % 60)
    kind = F.when(F.col("stage") == 0, "HYP-C").when(F.col("stage") == 1, "APNEA-O").when(F.col("stage") == 2, "APNEA-M").otherwise("POSS")
    extra = F.when(F.col("event_id") % 2 == 0, "PB ").otherwise("")
    return s.select("subject_id", (F.col("event_id") + 3).alias("line_no"), F.concat(clock, F.lit("  "), kind, F.lit("  "), extra, F.col("k").cast("string"), F.lit("  x")).alias("line"))


@query("io10_respiratory_events", f'WITH {RESP} SELECT subject_id, start, start + CAST(greatest(round_even(k, 0) - 1, 0) AS BIGINT) AS "end", label FROM l')
def io10(spark, sf):
    return labels.respiratory_events(resp_lines(spark, sf))


@query("io11_begin_end_notes", f"""WITH {SIG}, n AS (SELECT subject_id, t_us, k % 3 AS label, stage IN (0, 1) AS op FROM sig WHERE stage < 4), x AS (SELECT *, lag(CASE WHEN op THEN t_us END) OVER (PARTITION BY subject_id, label ORDER BY t_us) AS st FROM n) SELECT subject_id, 'e' || CAST(CAST(label AS BIGINT) AS VARCHAR) AS label, st AS start, t_us AS "end" FROM x WHERE NOT op AND st IS NOT NULL""")
def io11(spark, sf):
    name = F.concat(F.lit("e"), (F.col("k") % 3).cast("long").cast("string"))
    note = F.when(F.col("stage").isin(0, 1), F.concat(F.lit("("), name)).otherwise(F.concat(name, F.lit(")")))
    return labels.begin_end_pairs(sig(spark, sf).filter("stage < 4").select("subject_id", F.col("t_us").alias("t_sec"), note.alias("note")))


HOLD = f"""{SIG}, c AS (SELECT subject_id, t_us / {UNIT}.0 AS t, stage, lead(t_us) OVER (PARTITION BY subject_id ORDER BY t_us) / {UNIT}.0 AS nx FROM sig), h AS (SELECT subject_id, stage, unnest(range(CAST(ceil(t / 30 - 1e-9) AS BIGINT), CAST(floor(coalesce(nx, 744) / 30 + 1e-9) AS BIGINT))) AS epoch_index FROM c),
s AS (SELECT subject_id, unnest(range(24)) AS epoch_index FROM (SELECT DISTINCT subject_id FROM sig)), held AS (SELECT s.subject_id, s.epoch_index, coalesce(h.stage, -1) AS stage FROM s LEFT JOIN h USING (subject_id, epoch_index))"""


def held(spark, sf):
    s = sig(spark, sf)
    names = labels.mapped(F.col("stage"), {v: k for k, v in labels.NOTE_STAGES.items()}, "?")
    changes = s.select("subject_id", (F.col("t_us") / float(UNIT)).alias("t_sec"), names.alias("note"))
    return labels.held_stages(changes, s.select("subject_id").distinct().withColumn("length", F.lit(744.0)))


@query("io12_stage_forward_hold", f"WITH {HOLD} SELECT * FROM held")
def io12(spark, sf):
    return held(spark, sf)


@query("io15_subject_summary", f"""WITH {HOLD}, e AS (SELECT subject_id, count(*) * 30 / 3600.0 AS hours, count(*) FILTER (stage BETWEEN 1 AND 4) * 30 / 3600.0 AS sleep_hours FROM held GROUP BY 1), r AS (SELECT subject_id, count(*) FILTER (stage <= 3) AS n, count(*) FILTER (stage <= 2) AS ap, count(*) FILTER (stage = 0) AS c FROM sig GROUP BY 1)
SELECT subject_id, round(hours, 6) AS hours, round(sleep_hours, 6) AS sleep_hours, round(CASE WHEN sleep_hours > 0 THEN n / sleep_hours END, 6) AS ahi, round(CASE WHEN ap > 0 THEN c / CAST(ap AS DOUBLE) ELSE 0 END, 6) AS central_fraction FROM e JOIN r USING (subject_id)""")
def io15(spark, sf):
    ev = sig(spark, sf).select("subject_id", F.element_at(F.create_map(*[F.lit(x) for kv in enumerate(["APNEA-C", "APNEA-O", "APNEA-M", "HYP-C", "PERIODIC"]) for x in kv]), F.col("stage")).alias("label"))
    x = labels.subject_summary(held(spark, sf), ev)
    return x.select("subject_id", r6("hours"), r6("sleep_hours"), r6("ahi"), r6("central_fraction"))


# --- normalisation -----------------------------------------------------------------------------------------------


@query("m2_robust_by_subject", f"WITH {SIG}, q AS (SELECT subject_id, quantile_cont(v, 0.5) AS c, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS s FROM sig GROUP BY 1) SELECT event_id, round((v - c) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS v FROM sig JOIN q USING (subject_id)")
def m2a(spark, sf):
    return stats.normalise(sig(spark, sf), "v", "robust_by_subject").select("event_id", r6("v"))


@query("m2_standard_global_fit_on_train", f"WITH {SIG}, q AS (SELECT avg(v) AS c, stddev_pop(v) AS s FROM sig WHERE subject_id % 5 <> 0) SELECT event_id, round((v - c) / CASE WHEN s > 0 THEN s ELSE 1 END, 5) AS v FROM sig, q")
def m2b(spark, sf):
    s = sig(spark, sf)
    return stats.normalise(s, "v", "standard", fit_on=s.filter("subject_id % 5 <> 0")).select("event_id", F.round("v", 5).alias("v"))


@query("m2_robust_global", f"WITH {SIG}, q AS (SELECT quantile_cont(v, 0.5) AS c, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS s FROM sig) SELECT event_id, round((v - c) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS v FROM sig, q")
def m2c(spark, sf):
    return stats.normalise(sig(spark, sf), "v", "robust_global").select("event_id", r6("v"))


@query("m4_epoch_scaling", f"WITH {ROWS6}, q AS (SELECT subject_id, quantile_cont(v, 0.5) AS c, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS s FROM rows6 GROUP BY 1) SELECT subject_id, slot, round((v - c) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS v FROM rows6 JOIN q USING (subject_id)")
def m4(spark, sf):
    return stats.normalise(rows6(spark, sf), "v", "robust_by_subject").select("subject_id", "slot", r6("v"))


@query("x14_class_weights", f"WITH {SIG}, c AS (SELECT stage, count(*) AS n FROM sig GROUP BY 1), t AS (SELECT stage, n, sum(n) OVER () / (count(*) OVER () * CAST(n AS DOUBLE)) AS w FROM c) SELECT stage, n, round(w / (sum(w * n) OVER () / sum(n) OVER ()), 6) AS weight FROM t")
def x14(spark, sf):
    one = Window.partitionBy()  # one row per class
    c = sig(spark, sf).groupBy("stage").agg(F.count("*").alias("n"))
    c = c.withColumn("w", F.sum("n").over(one) / (F.count("*").over(one) * F.col("n").cast("double")))
    return c.select("stage", "n", r6(F.col("w") / (F.sum(F.col("w") * F.col("n")).over(one) / F.sum("n").over(one)), "weight"))


@query("x17_label_encoder", "WITH c AS (SELECT DISTINCT event_type FROM events) SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM c")
def x17(spark, sf):
    c = table(spark, sf, "events").select("event_type").distinct()  # one row per class
    return c.select("event_type", (F.row_number().over(Window.partitionBy().orderBy("event_type")) - 1).alias("code"))


# --- scores ------------------------------------------------------------------------------------------------------


@query("m6_binary_confusion", "SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels")
def m6(spark, sf):
    x = table(spark, sf, "labels")
    c = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    return x.agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(0, 0).alias("tn"))


@query("m7_class_scores", f"WITH {PAIRS}, l AS (SELECT unnest([0, 1, 2, 3, 4]) AS label), s AS (SELECT label, count(*) FILTER (truth = label AND pred = label) AS tp, count(*) FILTER (truth <> label AND pred = label) AS fp, count(*) FILTER (truth = label AND pred <> label) AS fn FROM l, pairs GROUP BY 1) SELECT label, tp, fp, fn, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS \"precision\", round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1 FROM s")
def m7(spark, sf):
    return stats.class_scores(pairs(spark, sf), "truth", "pred", LABELS).select("label", "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


@query("m8_confusion_matrix", f"WITH {PAIRS}, l AS (SELECT a.x AS truth, b.x AS pred FROM (SELECT unnest([0, 1, 2, 3, 4]) AS x) a, (SELECT unnest([0, 1, 2, 3, 4]) AS x) b) SELECT l.truth, l.pred, count(p.event_id) AS n FROM l LEFT JOIN pairs p USING (truth, pred) GROUP BY 1, 2")
def m8(spark, sf):
    return stats.confusion(pairs(spark, sf), "truth", "pred", LABELS)


def kappa_sql(by: str) -> str:
    g = f"{by}, " if by else ""
    join = f"USING ({by})" if by else "ON true"
    sel = f"t.{by}, " if by else ""
    return f"""t AS (SELECT {g}count(*) AS n, avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) AS po FROM pairs {'GROUP BY 1' if by else ''}),
a AS (SELECT {g}truth AS label, CAST(count(*) AS DOUBLE) AS nt FROM pairs GROUP BY ALL), b AS (SELECT {g}pred AS label, CAST(count(*) AS DOUBLE) AS np FROM pairs GROUP BY ALL), h AS (SELECT {g}truth AS label, CAST(count(*) AS DOUBLE) AS tp FROM pairs WHERE truth = pred GROUP BY ALL),
f AS (SELECT {g}label, coalesce(nt, 0) AS nt, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp FROM a FULL JOIN b USING ({g}label) LEFT JOIN h USING ({g}label)),
s AS (SELECT {g}sum(2 * tp / (nt + np)) / 5 AS macro_f1, sum(nt * np) AS e FROM f {'GROUP BY 1' if by else ''})
SELECT {sel}n, round(po, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(CASE WHEN e / (CAST(n AS DOUBLE) * n) >= 1 THEN 0 ELSE (po - e / (CAST(n AS DOUBLE) * n)) / (1 - e / (CAST(n AS DOUBLE) * n)) END, 6) AS kappa FROM t JOIN s {join}"""


@query("m9_summary", f"WITH {PAIRS}, {kappa_sql('')}")
def m9(spark, sf):
    return stats.summary(pairs(spark, sf), "truth", "pred", LABELS).select("n", r6("accuracy"), r6("macro_f1"), r6("kappa"))


@query("m29_per_subject_scores", f"WITH {PAIRS}, {kappa_sql('subject_id')}")
def m29(spark, sf):
    return stats.summary(pairs(spark, sf), "truth", "pred", LABELS, ("subject_id",)).select("subject_id", "n", r6("accuracy"), r6("macro_f1"), r6("kappa"))


@query("m10_prediction_scores", f"WITH {PAIRS}, l AS (SELECT truth, count(*) AS n, avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) AS recall FROM pairs GROUP BY 1) SELECT round(sum(recall * n) / sum(n), 6) AS accuracy, round(avg(recall), 6) AS balanced_accuracy FROM l")
def m10(spark, sf):
    g = pairs(spark, sf).groupBy("truth").agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("recall"))
    return g.agg(r6(F.sum(F.col("recall") * F.col("n")) / F.sum("n"), "accuracy"), r6(F.avg("recall"), "balanced_accuracy"))


AUC = """c AS (SELECT {g} v, count(*) AS n, sum(y) AS p FROM x GROUP BY ALL), q AS (SELECT *, coalesce(sum(n) OVER ({o} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS r FROM c), z AS (SELECT {g} sum(r * p) AS s, CAST(sum(p) AS DOUBLE) AS np, CAST(sum(n) - sum(p) AS DOUBLE) AS nn FROM q GROUP BY ALL)"""


@query("m11_cohens_d", f"WITH {SIG}, l AS (SELECT unnest([0, 1, 2, 3, 4]) AS label), m AS (SELECT label, count(*) FILTER (stage = label) AS na, count(*) FILTER (stage <> label) AS nb, avg(v) FILTER (stage = label) AS ma, avg(v) FILTER (stage <> label) AS mb, var_samp(v) FILTER (stage = label) AS va, var_samp(v) FILTER (stage <> label) AS vb FROM l, sig GROUP BY 1) SELECT label, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS d FROM m")
def m11(spark, sf):
    s = sig(spark, sf)
    row = s.agg(*[stats.cohens_d(F.col("v"), F.col("stage") == k).alias(f"d{k}") for k in LABELS])  # one scan for all classes
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.round(f"d{k}", 6).alias("d")) for k in LABELS])).alias("x")).select("x.*")


@query("m12_rank_auc", f"WITH {SIG}, x AS (SELECT v, CASE WHEN stage = 4 THEN 1 ELSE 0 END AS y FROM sig), {AUC.format(g='', o='')} SELECT CAST(np AS BIGINT) AS n_pos, CAST(nn AS BIGINT) AS n_neg, round((s - np * (np + 1) / 2) / (np * nn), 6) AS auc FROM z")
def m12(spark, sf):
    x = sig(spark, sf).withColumn("y", (F.col("stage") == 4).cast("int")).withColumn("g", F.lit(0))
    return stats.rank_auc(x, "v", "y", ("g",)).select("n_pos", "n_neg", r6("auc"))


@query("m13_feature_screen", f"WITH {SIG}, x AS (SELECT label, f, v, CASE WHEN stage = label THEN 1 ELSE 0 END AS y FROM (SELECT stage, 'v' AS f, v FROM sig UNION ALL SELECT stage, 'k', k FROM sig) u, (SELECT unnest([0, 1, 2, 3, 4]) AS label) l), {AUC.format(g='label, f,', o='PARTITION BY label, f')}, d AS (SELECT label, f, (avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0)) / sqrt(((count(*) FILTER (y = 1) - 1) * var_samp(v) FILTER (y = 1) + (count(*) FILTER (y = 0) - 1) * var_samp(v) FILTER (y = 0)) / (count(*) - 2)) AS d FROM x GROUP BY 1, 2) SELECT label, f AS feature, round(d, 6) AS d, round(greatest((s - np * (np + 1) / 2) / (np * nn), 1 - (s - np * (np + 1) / 2) / (np * nn)), 6) AS auc FROM z JOIN d USING (label, f) WHERE np >= 10")
def m13(spark, sf):
    s = sig(spark, sf)
    long = s.select("stage", F.explode(F.array(F.struct(F.lit("v").alias("feature"), F.col("v").alias("x")), F.struct(F.lit("k").alias("feature"), F.col("k").alias("x")))).alias("e")).select("stage", "e.*")
    per = long.select("feature", "x", F.explode(F.array(*[F.struct(F.lit(k).alias("label"), (F.col("stage") == k).cast("int").alias("y")) for k in LABELS])).alias("e")).select("feature", "x", "e.*")
    d = per.groupBy("label", "feature").agg(F.round(stats.cohens_d(F.col("x"), F.col("y") == 1), 6).alias("d"))
    a = stats.rank_auc(per, "x", "y", ("label", "feature")).filter("n_pos >= 10")
    return a.join(d, ["label", "feature"]).select("label", "feature", "d", r6(F.greatest("auc", 1 - F.col("auc")), "auc"))


@query("m14_pairwise_separability", f"WITH {SIG}, m AS (SELECT stage, CAST(count(*) AS DOUBLE) AS n, avg(v) AS m, var_samp(v) AS s FROM sig GROUP BY 1) SELECT a.stage AS a, b.stage AS b, round(abs(a.m - b.m) / sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2)), 6) AS d FROM m a JOIN m b ON a.stage < b.stage")
def m14(spark, sf):
    m = sig(spark, sf).groupBy("stage").agg(F.count("*").cast("double").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s"))
    a, b = m.alias("a"), m.alias("b")
    d = F.expr("abs(a.m - b.m) / sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2))")
    return a.join(b, F.expr("a.stage < b.stage")).select(F.col("a.stage").alias("a"), F.col("b.stage").alias("b"), r6(d, "d"))


@query("m18_subject_qc", f"WITH {SIG}, q AS (SELECT subject_id, count(*) AS n, avg(v) AS m FROM sig GROUP BY 1) SELECT subject_id, n, round((m - avg(m) OVER ()) / stddev_pop(m) OVER (), 5) AS z FROM q")
def m18(spark, sf):
    q = sig(spark, sf).groupBy("subject_id").agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    t = q.agg(F.avg("m").alias("c"), F.stddev_pop("m").alias("s"))
    return q.crossJoin(F.broadcast(t)).select("subject_id", "n", F.round(F.try_divide(F.col("m") - F.col("c"), F.col("s")), 5).alias("z"))  # t is one row


@query("m19_label_agreement", f"WITH {PAIRS} SELECT subject_id, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS agreement, count(*) AS n FROM pairs GROUP BY 1")
def m19(spark, sf):
    return pairs(spark, sf).groupBy("subject_id").agg(r6(F.avg((F.col("truth") == F.col("pred")).cast("double")), "agreement"), F.count("*").alias("n"))


@query("m21_group_effect", f"WITH {SIG}, g AS (SELECT stage, CAST(count(*) AS DOUBLE) AS n, avg(v) AS m, var_pop(v) AS s FROM sig GROUP BY 1), t AS (SELECT sum(n) AS n, CAST(count(*) AS DOUBLE) AS k, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b, sum(n * s) AS w FROM g) SELECT CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(b / (b + w), 6) AS eta2, round((b / (k - 1) - w / (n - k)) / (b / (k - 1) + (n / k - 1) * w / (n - k)), 6) AS icc FROM t")
def m21(spark, sf):
    return stats.group_effect(sig(spark, sf), "v", "stage").select("n", "k", r6("eta2"), r6("icc"))


@query("m22_norm_selection", f"WITH {SIG}, r AS (SELECT stage, subject_id, v AS x, 'none' AS norm FROM sig UNION ALL SELECT stage, subject_id, (v - median(v) OVER (PARTITION BY subject_id)), 'centred_by_subject' FROM sig), a AS (SELECT norm, stage AS g, CAST(count(*) AS DOUBLE) AS n, avg(x) AS m, var_pop(x) AS s FROM r GROUP BY 1, 2), b AS (SELECT norm, subject_id AS g, CAST(count(*) AS DOUBLE) AS n, avg(x) AS m, var_pop(x) AS s FROM r GROUP BY 1, 2), ea AS (SELECT norm, (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) + sum(n * s)) AS e FROM a GROUP BY 1), eb AS (SELECT norm, (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) + sum(n * s)) AS e FROM b GROUP BY 1) SELECT norm, round(ea.e - eb.e, 5) AS score FROM ea JOIN eb USING (norm)")
def m22(spark, sf):
    s = sig(spark, sf)
    med = s.groupBy("subject_id").agg(F.percentile("v", F.lit(0.5)).alias("med"))
    c = s.join(med, "subject_id")
    r = c.select("stage", "subject_id", F.explode(F.array(F.struct(F.lit("none").alias("norm"), F.col("v").alias("x")), F.struct(F.lit("centred_by_subject").alias("norm"), (F.col("v") - F.col("med")).alias("x")))).alias("e")).select("stage", "subject_id", "e.*")
    a, b = stats.group_effect(r, "x", "stage", ("norm",)), stats.group_effect(r, "x", "subject_id", ("norm",))
    return a.select("norm", F.col("eta2").alias("ea")).join(b.select("norm", F.col("eta2").alias("eb")), "norm").select("norm", F.round(F.col("ea") - F.col("eb"), 5).alias("score"))


@query("m27_spearman", f"WITH {SIG}, r AS (SELECT rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS a, rank() OVER (ORDER BY stage) + (count(*) OVER (PARTITION BY stage) - 1) / 2.0 AS b FROM sig) SELECT round(corr(a, b), 6) AS rho FROM r")
def m27(spark, sf):
    s = sig(spark, sf)

    def ranks(c):
        return rolling.rank_table(s, c).select(c, F.col("rank").alias("r_" + c))

    return s.join(ranks("v"), "v").join(ranks("stage"), "stage").agg(r6(F.corr("r_v", "r_stage"), "rho"))


@query("m28_secondwise_scoring", f"WITH {PAIRS}, c AS (SELECT count(*) FILTER (truth = 4 AND pred = 4) AS tp, count(*) FILTER (truth <> 4 AND pred = 4) AS fp, count(*) FILTER (truth = 4 AND pred <> 4) AS fn, count(*) FILTER (truth <> 4 AND pred <> 4) AS tn FROM pairs) SELECT round(tp / CAST(tp + fp AS DOUBLE), 6) AS \"precision\", round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(tn / CAST(tn + fp AS DOUBLE), 6) AS specificity FROM c")
def m28(spark, sf):
    t, p = F.col("truth") == 4, F.col("pred") == 4
    div = lambda a, b: F.coalesce(F.try_divide(F.count_if(a).cast("double"), F.count_if(b)), F.lit(0.0))
    return pairs(spark, sf).agg(r6(div(t & p, p), "precision"), r6(div(t & p, t), "recall"), r6(div(~t & ~p, ~t), "specificity"))


FOUR = "CASE {c} WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END"


@query("m31_four_class_scores", f"WITH {PAIRS}, q AS (SELECT {FOUR.format(c='truth')} AS t, {FOUR.format(c='pred')} AS p FROM pairs), a AS (SELECT t, CAST(count(*) AS DOUBLE) AS n FROM q GROUP BY 1), b AS (SELECT p, CAST(count(*) AS DOUBLE) AS n FROM q GROUP BY 1), e AS (SELECT sum(a.n * b.n) AS e FROM a JOIN b ON t = p), o AS (SELECT count(*) AS n, avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) AS po FROM q) SELECT n, round(po, 6) AS accuracy, round((po - e / (CAST(n AS DOUBLE) * n)) / (1 - e / (CAST(n AS DOUBLE) * n)), 6) AS kappa FROM o, e")
def m31(spark, sf):
    p = pairs(spark, sf).select(F.expr(FOUR.format(c="truth")).alias("truth"), F.expr(FOUR.format(c="pred")).alias("pred"))
    return stats.summary(p, "truth", "pred", [0, 1, 2, 3]).select("n", r6("accuracy"), r6("kappa"))


@query("m33_bout_statistics", f"WITH {ROWS6}, y AS (SELECT *, slot - row_number() OVER (PARTITION BY subject_id, stage ORDER BY slot) AS g FROM rows6), bt AS (SELECT stage, count(*) AS length FROM y GROUP BY subject_id, stage, g) SELECT stage, count(*) AS bouts, round(median(length), 6) AS median, round(avg(length), 6) AS mean, round(quantile_cont(length, 0.9), 6) AS p90, round(avg(CASE WHEN length = 1 THEN 1.0 ELSE 0.0 END), 6) AS single FROM bt GROUP BY 1")
def m33(spark, sf):
    b = runs.runs(rows6(spark, sf), "stage", "slot")
    q = lambda p: F.percentile("length", F.lit(p))
    return b.groupBy("stage").agg(F.count("*").alias("bouts"), r6(q(0.5), "median"), r6(F.avg("length"), "mean"), r6(q(0.9), "p90"), r6(F.avg(F.when(F.col("length") == 1, 1.0).otherwise(0.0)), "single"))


@query("m32_quality_scoring", f"WITH {PAIRS} SELECT 'all' AS part, count(*) AS n, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pairs UNION ALL SELECT 'retained', count(*), round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) FROM pairs WHERE v >= 10")
def m32(spark, sf):
    p = pairs(spark, sf).withColumn("part", F.explode(F.when(F.col("v") >= 10, F.array(F.lit("all"), F.lit("retained"))).otherwise(F.array(F.lit("all")))))
    return p.groupBy("part").agg(F.count("*").alias("n"), r6(F.avg((F.col("truth") == F.col("pred")).cast("double")), "accuracy"))


# --- context, encoders, decoders ---------------------------------------------------------------------------------


@query("cw1_centred_sequences", f"WITH {ROWS6}, u AS (SELECT *, min(slot) OVER w AS lo, max(slot) OVER w AS hi, count(*) OVER w AS n, sum(coalesce(v, 0)) OVER w AS s FROM rows6 WHERE slot % 17 <> 3 WINDOW w AS (PARTITION BY subject_id ORDER BY slot ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT subject_id, slot, stage, n AS steps, round(s, 6) AS total FROM u WHERE n = 5 AND hi - lo = 4")
def cw1(spark, sf):
    x = rolling.centred_sequences(rows6(spark, sf).filter("slot % 17 <> 3"), "slot", ["v", "k"], 2)
    total = F.aggregate("sequence", F.lit(0.0), lambda a, r: a + F.coalesce(F.get(r, F.lit(0)), F.lit(0.0)))
    return x.select("subject_id", "slot", "stage", F.size("sequence").cast("long").alias("steps"), r6(total, "total"))


@query("cw2_epoch_aligned_sequences", f"WITH {ROWS6}, u AS (SELECT *, min(slot) OVER w AS lo, max(slot) OVER w AS hi, count(*) OVER w AS n FROM rows6 WINDOW w AS (PARTITION BY subject_id ORDER BY slot ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)) SELECT subject_id, slot, stage, n AS steps FROM u WHERE n = 20 AND hi - lo = 19 AND slot % 5 = 0 AND stage >= 0")
def cw2(spark, sf):
    x = rolling.centred_sequences(rows6(spark, sf), "slot", ["v", "k"], 9, history=10)
    return x.filter("slot % 5 = 0 AND stage >= 0").select("subject_id", "slot", "stage", F.size("sequence").cast("long").alias("steps"))


@query("cw4_context_mean", f"WITH {ROWS6} SELECT subject_id, slot, round(avg(v) OVER w, 6) AS v__ctxmean, round(avg(k) OVER w, 6) AS k__ctxmean FROM rows6 WINDOW w AS (PARTITION BY subject_id ORDER BY slot ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def cw4(spark, sf):
    return rolling.context_mean(rows6(spark, sf), "slot", ["v", "k"], 2).select("subject_id", "slot", r6("v__ctxmean"), r6("k__ctxmean"))


@query("cw6_flat_context", f"WITH {ROWS6} SELECT subject_id, slot, round(lag(v, 2) OVER w, 6) AS ctx_m2__v, round(lag(v, 1) OVER w, 6) AS ctx_m1__v, round(v, 6) AS ctx_p0__v, round(lead(v, 1) OVER w, 6) AS ctx_p1__v, round(lead(v, 2) OVER w, 6) AS ctx_p2__v FROM rows6 WINDOW w AS (PARTITION BY subject_id ORDER BY slot)")
def cw6(spark, sf):
    names = ["ctx_m2__v", "ctx_m1__v", "ctx_p0__v", "ctx_p1__v", "ctx_p2__v"]
    return rolling.flat_context(rows6(spark, sf), "slot", ["v"], 2).select("subject_id", "slot", *[r6(n) for n in names])


@query("cw7_probability_context", f"WITH {SIG}, p AS (SELECT event_id, subject_id, t_us, least(greatest(v / 500, 0.0001), 0.9999) AS p FROM sig) SELECT event_id, round(ln(p / (1 - p)), 6) AS logit, round(p - lag(p) OVER (PARTITION BY subject_id ORDER BY t_us), 6) AS delta, round(-(p * ln(p) + (1 - p) * ln(1 - p)), 6) AS entropy FROM p")
def cw7(spark, sf):
    p = sig(spark, sf).withColumn("p", F.least(F.greatest(F.col("v") / 500, F.lit(0.0001)), F.lit(0.9999)))
    w = Window.partitionBy("subject_id").orderBy("t_us")
    q = 1 - F.col("p")
    return p.select("event_id", r6(F.ln(F.col("p") / q), "logit"), r6(F.col("p") - F.lag("p").over(w), "delta"), r6(-(F.col("p") * F.ln("p") + q * F.ln(q)), "entropy"))


@query("m5_window_encoder", f"WITH {ROWS6}, f AS (SELECT avg(v) AS m, stddev_pop(v) + 1e-6 AS s FROM rows6 WHERE subject_id % 5 <> 0), z AS (SELECT subject_id, slot, coalesce(least(greatest((v - m) / s, -10), 10), 0) AS z FROM rows6, f) SELECT subject_id, slot, " + ", ".join(f"round(coalesce(lag(z, {10 - i}) OVER w, 0), 5) AS z{i}" if i < 10 else f"round(coalesce(lead(z, {i - 10}) OVER w, 0), 5) AS z{i}" for i in (0, 5, 10, 15, 24)) + " FROM z WINDOW w AS (PARTITION BY subject_id ORDER BY slot)")
def m5(spark, sf):
    r = rows6(spark, sf)
    fit = r.filter("subject_id % 5 <> 0").agg(F.avg("v").alias("m"), (F.stddev_pop("v") + 1e-6).alias("s"))  # one row
    z = r.crossJoin(F.broadcast(fit)).withColumn("z", F.coalesce(F.least(F.greatest((F.col("v") - F.col("m")) / F.col("s"), F.lit(-10.0)), F.lit(10.0)), F.lit(0.0)))
    at = lambda i: F.round(F.coalesce((F.lag("z", 10 - i) if i < 10 else F.lead("z", i - 10)).over(W()), F.lit(0.0)), 5).alias(f"z{i}")
    return z.select("subject_id", "slot", *[at(i) for i in (0, 5, 10, 15, 24)])


TRANS = f"{SIG}, t AS (SELECT stage AS state, lead(stage) OVER (PARTITION BY subject_id ORDER BY t_us) AS next_state FROM sig), l AS (SELECT a.x AS state, b.x AS next_state FROM (SELECT unnest([0, 1, 2, 3, 4]) AS x) a, (SELECT unnest([0, 1, 2, 3, 4]) AS x) b), c AS (SELECT l.state, l.next_state, count(t.state) AS n FROM l LEFT JOIN t USING (state, next_state) GROUP BY 1, 2)"


@query("d1_transition_matrix", f"WITH {TRANS} SELECT state, next_state, n, round((n + 1.0) / sum(n + 1.0) OVER (PARTITION BY state), 6) AS p FROM c")
def d1(spark, sf):
    return decoders.transition_counts(sig(spark, sf), "stage", "t_us", 5).select("state", "next_state", "n", r6("p"))


@query("d1_initial_shares", f"WITH {SIG}, f AS (SELECT subject_id, arg_min(stage, t_us) AS state FROM sig GROUP BY 1), l AS (SELECT unnest([0, 1, 2, 3, 4]) AS state), c AS (SELECT l.state, count(f.state) AS n FROM l LEFT JOIN f USING (state) GROUP BY 1) SELECT state, n, round((n + 1.0) / sum(n + 1.0) OVER (), 6) AS p FROM c")
def d1b(spark, sf):
    return decoders.initial_shares(sig(spark, sf), "stage", "t_us", 5).select("state", "n", r6("p"))


@query("d2_emission_counts", f"WITH {PAIRS}, l AS (SELECT a.x AS state, b.x AS obs FROM (SELECT unnest([0, 1, 2, 3, 4]) AS x) a, (SELECT unnest([0, 1, 2, 3, 4]) AS x) b), c AS (SELECT l.state, l.obs, count(p.truth) + 1 AS n FROM l LEFT JOIN pairs p ON p.truth = l.state AND p.pred = l.obs GROUP BY 1, 2) SELECT state, obs, n, round(n / sum(n) OVER (PARTITION BY state), 6) AS p FROM c")
def d2(spark, sf):
    return decoders.emission_counts(pairs(spark, sf), "truth", "pred", 5).select("state", "obs", "n", r6("p"))


@query("d3_forward_backward")
def d3(spark, sf):
    s = sig(spark, sf)
    trans = decoders.matrix(decoders.transition_counts(s, "stage", "t_us", 5), 5)
    init = [r["p"] for r in decoders.initial_shares(s, "stage", "t_us", 5).orderBy("state").collect()]
    p = pairs(spark, sf).withColumn("probs", F.array(*[F.when(F.col("pred") == k, 0.8).otherwise(0.05) for k in LABELS]))
    out = decoders.smooth_nights(p, "t_us", "probs", trans, init)
    return out.select("subject_id", "t_us", F.transform("smoothed", lambda x: F.round(x, 6)).alias("smoothed"), "decoded")


@query("d4_viterbi")
def d4(spark, sf):
    s = sig(spark, sf)
    trans = decoders.matrix(decoders.transition_counts(s, "stage", "t_us", 5), 5)
    emission = decoders.matrix(decoders.emission_counts(pairs(spark, sf), "truth", "pred", 5), 5, "obs")
    return decoders.decode_nights(pairs(spark, sf), "t_us", "pred", trans, emission)


@query("d5_hsmm_learning", f"WITH {ROWS6}, y AS (SELECT *, slot - row_number() OVER (PARTITION BY subject_id, stage ORDER BY slot) AS g FROM rows6 WHERE stage >= 0), bt AS (SELECT stage, count(*) AS length FROM y GROUP BY subject_id, stage, g) SELECT stage, round(greatest(avg(length), 1), 6) AS rate, max(length) AS longest, count(*) AS runs FROM bt GROUP BY 1")
def d5(spark, sf):
    b = runs.runs(rows6(spark, sf).filter("stage >= 0"), "stage", "slot", consecutive=True)
    return decoders.learn_hsmm(b, "stage").select("stage", r6("rate"), "longest", "runs")


@query("d7_ordered_sequences", f"WITH {SIG} SELECT subject_id, list(stage ORDER BY t_us)[1] AS first_stage, list(stage ORDER BY t_us)[-1] AS last_stage, count(*) AS n FROM sig GROUP BY 1")
def d7(spark, sf):
    return sig(spark, sf).groupBy("subject_id").agg(F.min_by("stage", "t_us").alias("first_stage"), F.max_by("stage", "t_us").alias("last_stage"), F.count("*").alias("n"))
