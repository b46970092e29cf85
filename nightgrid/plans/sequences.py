"""Queries for tensors, label builders, frames, window scores and importance of markers (survey 2.1, 2.2, 2.9, 2.10, 2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.operators import binning, labels, markers, sequences, stats

from . import models
from .adapter import EPISODES, PAIRS, ROW, ROWS6, SIG, UNIT, episodes, pairs, rows6, sig
from .registry import query, r6
from .statistics import HOLD, held


@query("io13_second_track", f"WITH {HOLD} SELECT subject_id, epoch_index * 30 + s AS second, stage FROM held, range(30) t(s)")
def io13(spark, sf):
    return sequences.second_track(held(spark, sf))


@query("io13_whole_second_events", f'WITH {SIG} SELECT event_id, CAST(floor(t_us / 1e9) AS BIGINT) AS start, CAST(ceil((t_us + v * 1e9) / 1e9) AS BIGINT) - 1 AS "end" FROM sig')
def io13b(spark, sf):
    return sequences.whole_second_events(sig(spark, sf).select("event_id", (F.col("t_us") / 1e9).alias("start"), ((F.col("t_us") + F.col("v") * 1e9) / 1e9).alias("end")))


@query("io14_hypnogram", f"WITH {SIG}, l AS (SELECT subject_id, stage, row_number() OVER (PARTITION BY subject_id ORDER BY t_us) - 1 AS epoch_index FROM sig WHERE k < 90), s AS (SELECT subject_id, unnest(range(70)) AS epoch_index FROM (SELECT DISTINCT subject_id FROM sig)) SELECT s.subject_id, s.epoch_index, coalesce(CASE WHEN l.stage = 4 THEN 3 ELSE l.stage END, -1) AS stage FROM s LEFT JOIN l USING (subject_id, epoch_index)")
def io14(spark, sf):
    s = sig(spark, sf)
    line = F.when(F.col("k") < 90, F.col("stage").cast("string")).otherwise("scored twice")
    lines = s.select("subject_id", F.col("t_us").alias("line_no"), line.alias("line"))
    lengths = s.select("subject_id").distinct().withColumn("length", F.lit(2110.0))
    return sequences.hypnogram(lines, lengths, labels.mapped(F.col("code"), labels.ISRUC_STAGES, -1))


@query("io14_codes_on_a_line", f"WITH {SIG}, o AS (SELECT subject_id, stage, row_number() OVER (PARTITION BY subject_id ORDER BY t_us) - 1 AS i FROM sig), l AS (SELECT subject_id, stage, 2 * i + x AS epoch_index FROM o, range(2) t(x)), s AS (SELECT subject_id, unnest(range(160)) AS epoch_index FROM (SELECT DISTINCT subject_id FROM sig)) SELECT s.subject_id, s.epoch_index, coalesce(CASE WHEN l.stage = 4 THEN 3 ELSE l.stage END, -1) AS stage FROM s LEFT JOIN l USING (subject_id, epoch_index)")
def io14b(spark, sf):
    """Two codes on each line, with words and spaces about them."""
    s = sig(spark, sf)
    lines = s.select("subject_id", F.col("t_us").alias("line_no"), F.format_string("  %d\tand %d ", "stage", "stage").alias("line"))
    lengths = s.select("subject_id").distinct().withColumn("length", F.lit(160 * 30.0))
    return sequences.hypnogram(lines, lengths, labels.mapped(F.col("code"), labels.ISRUC_STAGES, -1))


@query("p5_experiment_frame", f"WITH {ROWS6} SELECT subject_id, slot, round(v, 6) AS v, round(k, 6) AS k, stage FROM rows6 WHERE v IS NOT NULL AND k IS NOT NULL AND stage >= 0")
def p5(spark, sf):
    return sequences.experiment_frame(rows6(spark, sf), ["v", "k"], "stage").select("subject_id", "slot", r6("v"), r6("k"), "stage")


@query("x38_finite_group", f"WITH {ROWS6} SELECT subject_id, slot, round(v, 6) AS v FROM rows6 WHERE v IS NOT NULL")
def x38(spark, sf):
    return sequences.finite_group(rows6(spark, sf), "v", "stage").select("subject_id", "slot", r6("v"))


@query("s2_night_bounds", f"WITH {SIG} SELECT event_id, row_number() OVER (PARTITION BY subject_id ORDER BY t_us) - 1 AS place, count(*) OVER (PARTITION BY subject_id) AS size FROM sig")
def s2(spark, sf):
    return sequences.night_bounds(sig(spark, sf), "t_us").select("event_id", "place", "size")


PLACES = f"WITH {ROWS6}, q AS (SELECT *, row_number() OVER (PARTITION BY subject_id, slot // 11 ORDER BY slot) - 1 AS p, count(*) OVER (PARTITION BY subject_id, slot // 11) AS n FROM rows6)"


@query("x8_target_rows", PLACES + " SELECT subject_id, slot // 11 AS block, round(sum(CASE WHEN stage = 4 THEN 1.0 ELSE 0 END), 6) AS event_seconds, round(sum(CASE WHEN stage = 4 THEN 1.0 ELSE 0 END) / count(*), 6) AS event_fraction, max(CASE WHEN p = least(1, n - 1) THEN stage END) AS stage FROM q GROUP BY 1, 2")
def x8(spark, sf):
    x = rows6(spark, sf).withColumn("hit", F.when(F.col("stage") == 4, 1.0))
    return sequences.target_row(x, "slot", "hit", ["stage"], 11, 1).select("subject_id", "block", r6("event_seconds"), r6("event_fraction"), "stage")


@query("x8_target_rows_of_six_seconds", PLACES + " SELECT subject_id, slot // 11 AS block, round(sum(CASE WHEN stage = 4 THEN 6.0 ELSE 0 END), 6) AS event_seconds, round(sum(CASE WHEN stage = 4 THEN 6.0 ELSE 0 END) / (6 * count(*)), 6) AS event_fraction, max(CASE WHEN p = least(8, n - 1) THEN stage END) AS stage FROM q GROUP BY 1, 2")
def x8b(spark, sf):
    """Rows of six seconds: the anchor is the row at 50 s, or the last of a shorter block."""
    x = rows6(spark, sf).withColumn("hit", F.when(F.col("stage") == 4, 1.0))
    return sequences.target_row(x, "slot", "hit", ["stage"], 11, 50, seconds_per_row=6).select("subject_id", "block", r6("event_seconds"), r6("event_fraction"), "stage")


@query("w10_truth_and_events", f"""WITH {ROWS6}, {EPISODES}, ev AS (SELECT subject_id, start, "end", CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM a WHERE start >= 0), h AS (SELECT subject_id, kind, unnest(range(start // 7, "end" // 7 + 1)) AS slot FROM ev), hc AS (SELECT subject_id, slot, count(*) AS n, count(*) FILTER (kind = 'even') AS ev, count(*) FILTER (kind = 'odd') AS od FROM h GROUP BY 1, 2),
tk AS (SELECT subject_id, t_us // {UNIT} // 7 AS slot, stage, count(*) AS n FROM sig WHERE stage >= 0 GROUP BY 1, 2, 3), md AS (SELECT subject_id, slot, arg_max(stage, n * 100 - stage) AS code FROM tk GROUP BY 1, 2)
SELECT r.subject_id, r.slot, coalesce(hc.n, 0) AS events, coalesce(hc.ev, 0) AS event__even, coalesce(hc.od, 0) AS event__odd, coalesce(hc.n, 0) > 0 AS event__any, coalesce(md.code, -1) AS label__stage, CASE md.code WHEN 0 THEN 'wake' WHEN 1 THEN 'n1' WHEN 2 THEN 'n2' WHEN 3 THEN 'n3' WHEN 4 THEN 'rem' ELSE 'unknown' END AS label__stage__class,
round(lag(r.v, 1) OVER w, 6) AS v__prev1 FROM rows6 r LEFT JOIN hc USING (subject_id, slot) LEFT JOIN md USING (subject_id, slot) WINDOW w AS (PARTITION BY r.subject_id ORDER BY r.slot)""")
def w10b(spark, sf):
    """Truth tracks by row with their classes, and events by type."""
    events = episodes(spark, sf)[0].filter("start >= 0").withColumn("kind", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    track = sig(spark, sf).select("subject_id", F.floor(F.col("t_us") / UNIT).cast("long").alias("second"), F.col("stage").alias("code"))
    classes = {0: "wake", 1: "n1", 2: "n2", 3: "n3", 4: "rem"}
    x = sequences.enriched(rows6(spark, sf), "slot", ["stage"], events, [1], ["v"], 7, tracks={"stage": (track, classes)}, kinds=["even", "odd"])
    return x.select("subject_id", "slot", "events", "event__even", "event__odd", "event__any", "label__stage", "label__stage__class", r6("v__prev1"))


@query("w10_enrichment", f'WITH {ROWS6}, {EPISODES}, h AS (SELECT subject_id, unnest(range(start // 7, "end" // 7 + 1)) AS slot FROM a), hc AS (SELECT subject_id, slot, count(*) AS n FROM h GROUP BY 1, 2) SELECT r.subject_id, r.slot, r.stage >= 0 AS stage__known, coalesce(hc.n, 0) AS events, round(lag(r.v, 1) OVER w, 6) AS v__prev1, round(lag(r.v, 5) OVER w, 6) AS v__prev5 FROM rows6 r LEFT JOIN hc USING (subject_id, slot) WINDOW w AS (PARTITION BY r.subject_id ORDER BY r.slot)')
def w10(spark, sf):
    x = sequences.enriched(rows6(spark, sf), "slot", ["stage"], episodes(spark, sf)[0].filter("start >= 0"), [1, 5], ["v"], 7)
    return x.select("subject_id", "slot", "stage__known", "events", r6("v__prev1"), r6("v__prev5"))


NESTED = f"""WITH {ROWS6}, u AS (SELECT *, count(*) OVER w AS n, min(slot) OVER w AS lo, max(slot) OVER w AS hi, list(coalesce(v, 0)) OVER w AS a, list(stage) OVER (PARTITION BY subject_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ls FROM rows6 WINDOW w AS (PARTITION BY subject_id ORDER BY slot ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)),
f AS (SELECT * FROM u WHERE n = 20 AND hi - lo = 19 AND slot % 5 = 0), nm AS (SELECT subject_id, slot, a, (SELECT min(c) FROM (SELECT c, count(*) AS k FROM (SELECT unnest(ls) AS c) WHERE c >= 0 GROUP BY c) q WHERE k = (SELECT max(k) FROM (SELECT count(*) AS k FROM (SELECT unnest(ls) AS c) WHERE c >= 0 GROUP BY c))) AS stage FROM f)"""


@query("cw3_hierarchical_sequences", NESTED + " SELECT subject_id, slot, stage, 4 AS epochs, 5 AS steps, round(a[6], 6) AS second_epoch_first, round(a[20], 6) AS last FROM nm WHERE stage IS NOT NULL")
def cw3(spark, sf):
    x = sequences.sequences(rows6(spark, sf), "hierarchical", slot="slot", label="stage", features=["v", "k"], history=2, current=1, future=1, steps=5)
    at = lambda e, s: F.coalesce(F.get(F.get(F.get("sequence", F.lit(e)), F.lit(s)), F.lit(0)), F.lit(0.0))
    return x.select("subject_id", "slot", "stage", F.size("sequence").alias("epochs"), F.size(F.get("sequence", F.lit(0))).alias("steps"), r6(at(1, 0), "second_epoch_first"), r6(at(3, 4), "last"))


@query("cw5_flattened_sequences", NESTED + " SELECT subject_id, slot, 20 AS n, round(list_sum(a), 6) AS total FROM nm WHERE stage IS NOT NULL")
def cw5(spark, sf):
    x = sequences.hierarchical(rows6(spark, sf), "slot", "stage", ["v"], 2, 1, 1, 5)
    flat = sequences.flattened(sequences.flattened("sequence"))
    return x.select("subject_id", "slot", F.size(flat).alias("n"), r6(F.aggregate(flat, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))), "total"))


@query("cw9_fine_steps", f"WITH {ROWS6}, e AS (SELECT DISTINCT subject_id, slot // 5 AS epoch_index FROM rows6), w AS (SELECT e.subject_id, e.epoch_index, i, r.v FROM e CROSS JOIN range(25) t(i) LEFT JOIN rows6 r ON r.subject_id = e.subject_id AND r.slot = (e.epoch_index - 2) * 5 + i) SELECT subject_id, epoch_index, count(*) AS n, count(v) AS known, round(sum(v), 6) AS total, round(max(v) FILTER (i = 10), 6) AS first FROM w GROUP BY 1, 2")
def cw9(spark, sf):
    r = rows6(spark, sf)
    seconds = r.select("subject_id", (F.col("slot") * 6).alias("second"), "v")
    x = sequences.fine_steps(seconds, r.select("subject_id", F.floor(F.col("slot") / 5).cast("long").alias("epoch_index")).distinct(), ["v"])
    known = F.filter("steps", lambda v: v.isNotNull())
    total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v))
    return x.select("subject_id", "epoch_index", F.size("steps").cast("long").alias("n"), F.size(known).cast("long").alias("known"), r6(total, "total"), r6(F.get("steps", F.lit(10)), "first"))


@query("x18_tensor_scaling", f"WITH {ROWS6}, q AS (SELECT quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS s FROM rows6 WHERE stage >= 2) SELECT subject_id, slot, round(coalesce((v - m) / CASE WHEN s >= 1e-6 THEN s ELSE 1 END, 0), 6) AS v FROM rows6, q")
def x18(spark, sf):
    r = rows6(spark, sf)
    return sequences.robust_tensor(r, r.filter("stage >= 2"), ["v"]).select("subject_id", "slot", r6("v"))


@query("x22_epoch_skeleton", f"WITH {ROWS6}, f AS (SELECT subject_id, slot // 5 AS epoch_index FROM rows6 GROUP BY 1, 2 HAVING count(*) = 5), ec AS (SELECT subject_id, slot // 5 AS epoch_index, stage, count(*) AS n FROM rows6 WHERE stage >= 0 GROUP BY 1, 2, 3), em AS (SELECT *, row_number() OVER (PARTITION BY subject_id, epoch_index ORDER BY n DESC, stage) AS r FROM ec) SELECT f.subject_id, f.epoch_index, em.stage FROM f JOIN em USING (subject_id, epoch_index) WHERE r = 1")
def x22(spark, sf):
    return sequences.epoch_labels(rows6(spark, sf), "slot", "stage")


@query("x33_night_windows", f"WITH {ROWS6}, nm AS (SELECT subject_id, median(v) AS m FROM rows6 GROUP BY 1), d AS (SELECT subject_id, median(abs(v - m)) AS d FROM rows6 JOIN nm USING (subject_id) GROUP BY 1), z AS (SELECT subject_id, slot, coalesce(least(greatest((v - m) / CASE WHEN d > 0 THEN 1.4826 * d ELSE 1 END, -6), 6), 0) AS z FROM rows6 JOIN nm USING (subject_id) JOIN d USING (subject_id)) SELECT subject_id, slot, count(*) OVER w AS n, round(sum(z) OVER w, 6) AS total FROM z WINDOW w AS (PARTITION BY subject_id ORDER BY slot ROWS BETWEEN 5 PRECEDING AND 9 FOLLOWING)")
def x33(spark, sf):
    x = sequences.clipped_windows(rows6(spark, sf), "slot", "v", 5, 9)
    return x.select("subject_id", "slot", F.size("window").cast("long").alias("n"), r6(F.aggregate("window", F.lit(0.0), lambda a, v: a + v), "total"))


@query("f52_aligned_probabilities", f"WITH {SIG}, p AS (SELECT event_id, v / 500 AS a, k / 100 AS b FROM sig) SELECT event_id, round(CASE WHEN a + b > 0 THEN b / (a + b) ELSE b END, 6) AS p0, 0.0 AS p1, round(CASE WHEN a + b > 0 THEN a / (a + b) ELSE a END, 6) AS p2 FROM p")
def f52(spark, sf):
    p = sig(spark, sf).select("event_id", F.array(F.col("v") / 500, F.col("k") / 100).alias("proba"))
    x = p.withColumn("p", sequences.aligned_probabilities("proba", [2, 0], [0, 1, 2]))
    return x.select("event_id", *[r6(F.get("p", F.lit(k)), f"p{k}") for k in range(3)])


@query("f53_resampled_window", "WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS x FROM embeddings), p AS (SELECT vec_id, x, k, (2 + (k + 0.5) * (8.0 / 10)) * 4 - 8 AS pos FROM e, range(10) t(k)) SELECT vec_id, k, round(x[9 + CAST(floor(pos) AS INT)] + (pos - floor(pos)) * (x[10 + CAST(floor(pos) AS INT)] - x[9 + CAST(floor(pos) AS INT)]), 6) AS v FROM p")
def f53(spark, sf):
    from .signals import vectors

    x = vectors(spark, sf).withColumn("w", sequences.resampled_window("x", 4.0, F.lit(2.0), 8.0, 10))
    return x.select("vec_id", F.posexplode("w").alias("k", "v")).withColumns({"k": F.col("k").cast("long"), "v": r6("v")})


@query("m17_harvest_series", f"WITH {SIG}, s AS (SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY t_us) - 1 AS i, v, k FROM sig), n AS (SELECT subject_id, max(i) AS m FROM s GROUP BY 1), g AS (SELECT subject_id, j, j * m / 49.0 AS x FROM n, range(50) t(j)) SELECT g.subject_id, g.j, round(a.v + CASE WHEN x > floor(x) THEN (x - floor(x)) * (b.v - a.v) ELSE 0 END, 6) AS v, round(a.k + CASE WHEN x > floor(x) THEN (x - floor(x)) * (b.k - a.k) ELSE 0 END, 6) AS k FROM g JOIN s a ON a.subject_id = g.subject_id AND a.i = CAST(floor(x) AS BIGINT) LEFT JOIN s b ON b.subject_id = g.subject_id AND b.i = CAST(floor(x) AS BIGINT) + 1")
def m17(spark, sf):
    s = sig(spark, sf).withColumn("i", F.row_number().over(Window.partitionBy("subject_id").orderBy("t_us")) - 1)
    out = None
    for c in ("v", "k"):
        x = binning.resample_linear(s, "i", c, 50)
        out = x if out is None else out.join(x, ["subject_id", "j"])
    return out.select("subject_id", F.col("j").cast("long").alias("j"), r6("v"), r6("k"))


def subject_f1(pred, truth: str, guess: str):
    """Macro F1 of each subject over the classes it has."""
    c = pred.groupBy("subject_id", truth, guess).agg(F.count("*").alias("n"))
    t = c.groupBy("subject_id", F.col(truth).alias("c")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)).alias("hit"))
    g = c.groupBy("subject_id", F.col(guess).alias("c")).agg(F.sum("n").alias("g"))
    f = t.join(g, ["subject_id", "c"], "left").withColumn("f1", 2 * F.col("hit") / (F.col("t") + F.coalesce("g", F.lit(0))))
    return f.groupBy("subject_id").agg(F.avg("f1").alias("f1"))


@query("m30_window_scores", f"WITH {PAIRS}, c AS (SELECT subject_id, truth, pred, count(*) AS n FROM pairs GROUP BY 1, 2, 3), t AS (SELECT subject_id, truth AS c, sum(n) AS t, sum(CASE WHEN truth = pred THEN n ELSE 0 END) AS hit FROM c GROUP BY 1, 2), g AS (SELECT subject_id, pred AS c, sum(n) AS g FROM c GROUP BY 1, 2), f AS (SELECT subject_id, avg(2.0 * hit / (t + coalesce(g, 0))) AS f1 FROM t LEFT JOIN g USING (subject_id, c) GROUP BY 1) SELECT count(*) AS subjects, round(median(f1), 6) AS subj_median, round(min(f1), 6) AS subj_min, arg_min(subject_id, (f1, subject_id)) AS worst_subject FROM f")
def m30(spark, sf):
    f = subject_f1(pairs(spark, sf), "truth", "pred")
    return f.agg(F.count("*").alias("subjects"), r6(F.percentile("f1", F.lit(0.5)), "subj_median"), r6(F.min("f1"), "subj_min"), F.min_by("subject_id", F.struct("f1", "subject_id")).alias("worst_subject"))


@query("x28_four_class_table", f"WITH {PAIRS}, u AS (SELECT 'a' AS model, truth, pred FROM pairs UNION ALL SELECT 'b', truth, truth FROM pairs), r AS (SELECT model, CASE WHEN truth IN (1, 2) THEN 1 WHEN truth = 3 THEN 2 WHEN truth = 4 THEN 3 ELSE truth END AS t, CASE WHEN pred IN (1, 2) THEN 1 WHEN pred = 3 THEN 2 WHEN pred = 4 THEN 3 ELSE pred END AS p FROM u), n AS (SELECT model, count(*) AS n, avg(CASE WHEN t = p THEN 1.0 ELSE 0 END) AS po FROM r GROUP BY 1), m AS (SELECT a.model, sum(a.c * b.c) AS e FROM (SELECT model, t, CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY 1, 2) a JOIN (SELECT model, p, CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY 1, 2) b ON a.model = b.model AND a.t = b.p GROUP BY 1) SELECT model, n, round(po, 6) AS accuracy4, round((po - e / n / n) / (1 - e / n / n), 6) AS kappa4 FROM n JOIN m USING (model)")
def x28(spark, sf):
    p = pairs(spark, sf)
    x = sequences.union_scores({"a": p, "b": p.withColumn("pred", F.col("truth"))}, {0: 0, 1: 1, 2: 1, 3: 2, 4: 3}, "truth", "pred")
    out = stats.summary(x, "truth4", "pred4", [0, 1, 2, 3], ("model",))
    n = x.groupBy("model").agg(F.count("*").alias("n"))
    return n.join(out, "model").select("model", n["n"], r6("accuracy", "accuracy4"), r6("kappa", "kappa4"))


@query("x6_consolidated_outputs", f"WITH {SIG} SELECT 'a' || CAST(stage AS VARCHAR) AS algo, count(DISTINCT CAST(k AS INT) % 7) AS signals FROM sig GROUP BY 1")
def x6(spark, sf):
    t = sig(spark, sf).select(F.concat(F.lit("a"), F.col("stage").cast("string")).alias("algo"), F.concat(F.lit("s"), (F.col("k").cast("int") % 7).cast("string")).alias("signal"))
    return sequences.consolidated(t).select("algo", F.size("signals").cast("long").alias("signals"))


@query("io18_scalar_columns", f"WITH {SIG} SELECT event_id, round(v, 6) AS v, 'night' AS name, 2.5 AS rate FROM sig")
def io18(spark, sf):
    return sequences.broadcast_scalars(sig(spark, sf).select("event_id", r6("v")), {"name": "night", "rate": 2.5})


@query("v3_inner_validation", f"WITH {SIG}, s AS (SELECT DISTINCT subject_id FROM sig), n AS (SELECT *, row_number() OVER (ORDER BY CAST(subject_id AS VARCHAR)) - 1 AS i, count(*) OVER () AS n FROM s) SELECT subject_id, ((i - (2 - 1 + 7) % n) % n + n) % n < 3 AS validation FROM n")
def v3(spark, sf):
    return models.inner_validation(sig(spark, sf).select("subject_id"), 2, 3, 7)


@query("m34_marker_effects", f"WITH {SIG}, z AS (SELECT stage, v, (v - avg(v) OVER (PARTITION BY subject_id)) / nullif(stddev_samp(v) OVER (PARTITION BY subject_id), 0) AS z FROM sig), l AS (SELECT unnest([0, 1, 2, 3, 4]) AS c), g AS (SELECT c, v, z, stage = c AS own FROM z, l) SELECT c AS class, " + ", ".join(f"round((avg({x}) FILTER (own) - avg({x}) FILTER (NOT own)) / sqrt(((count({x}) FILTER (own) - 1) * var_samp({x}) FILTER (own) + (count({x}) FILTER (NOT own) - 1) * var_samp({x}) FILTER (NOT own)) / (count({x}) - 2)), 6) AS d_{n}" for x, n in (("v", "raw"), ("z", "scaled"))) + " FROM g GROUP BY 1")
def m34(spark, sf):
    w = Window.partitionBy("subject_id")
    z = sig(spark, sf).withColumn("z", (F.col("v") - F.avg("v").over(w)) / F.nullif(F.stddev_samp("v").over(w), F.lit(0.0)))
    g = z.withColumn("class", F.explode(F.array(*[F.lit(c) for c in range(5)])))
    own = F.col("stage") == F.col("class")
    return g.groupBy("class").agg(*[r6(stats.cohens_d(F.col(x), own), f"d_{n}") for x, n in (("v", "raw"), ("z", "scaled"))])


@query("f49_epoch_markers", f"""WITH {SIG}, s AS MATERIALIZED (SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY t_us) - 1 AS i, v, k, v * k / 100 AS low, k * k / 100 AS theta FROM sig),
m AS (SELECT subject_id, median(v) AS mv, median(k) AS mk, median(theta) AS mt, avg(low) AS ml, avg(v) AS av, avg(k) AS ak, var_pop(k) AS kk, var_pop(v) AS vv, covar_pop(k, v) AS kv, covar_pop(k, low) AS kl, covar_pop(v, low) AS vl FROM s GROUP BY 1),
d AS (SELECT subject_id, median(abs(v - mv)) AS dv, median(abs(theta - mt)) AS dt FROM s JOIN m USING (subject_id) GROUP BY 1),
f AS (SELECT *, kk * vv - kv * kv > 1e-10 * kk * vv AS two FROM m),
c AS (SELECT *, CASE WHEN two THEN (kl * vv - vl * kv) / (kk * vv - kv * kv) WHEN kk > 0 THEN kl / kk ELSE 0 END AS fk, CASE WHEN two THEN (vl * kk - kl * kv) / (kk * vv - kv * kv) WHEN kk <= 0 AND vv > 0 THEN vl / vv ELSE 0 END AS fv FROM f),
w AS (SELECT *, quantile_cont(v, 0.5) OVER x AS med, list(v) OVER x AS near FROM s WINDOW x AS (PARTITION BY subject_id ORDER BY i ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)),
j AS (SELECT *, 1.4826 * list_aggregate(list_transform(near, lambda y: abs(y - med)), 'median') AS sd FROM w),
e AS MATERIALIZED (SELECT subject_id, i // 30 AS epoch_index, count(*) FILTER (v > mv + 2 * 1.4826 * dv AND k < mk) AS rem_eye_bursts, count(*) FILTER (sd > 0 AND v > med + 2.5 * sd AND k > mk) AS kcomplex_events,
 avg(low - (ml + fk * (k - ak) + fv * (v - av))) AS slow, avg(k) AS alpha, avg(v) AS chin, count(*) FILTER (theta > mt + 2 * 1.4826 * dt AND v < mv) AS sawtooth_theta FROM j JOIN c USING (subject_id) JOIN d USING (subject_id) GROUP BY 1, 2),
q AS (SELECT subject_id, quantile_cont(chin, 0.75) AS tense FROM e GROUP BY 1), l AS (SELECT subject_id, median(alpha) AS level FROM e JOIN q USING (subject_id) WHERE chin > tense GROUP BY 1)
SELECT subject_id, epoch_index, rem_eye_bursts, kcomplex_events, round(slow, 6) AS slow_eye_movements, round(alpha / nullif(level, 0), 6) AS alpha_dropout, sawtooth_theta FROM e LEFT JOIN l USING (subject_id)""")
def f49(spark, sf):
    s = sig(spark, sf).withColumn("second", F.row_number().over(Window.partitionBy("subject_id").orderBy("t_us")) - 1)
    as_track = {"eog_high": "v", "eog_low": "v * k / 100", "f_rel_delta": "k", "c_log_power": "v", "c_rel_delta": "k", "c_rel_theta": "k * k / 100", "emg_log_rms": "v", "o_rel_alpha": "k"}
    x = markers.epoch_markers(s.select("subject_id", "second", *[F.expr(e).alias(c) for c, e in as_track.items()]))
    return x.select("subject_id", "epoch_index", "rem_eye_bursts", "kcomplex_events", r6("slow_eye_movements"), r6("alpha_dropout"), "sawtooth_theta")


@query("x2_array_features", f"""WITH {SIG}, i AS (SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY t_us) - 1 AS i, v FROM sig), n AS (SELECT subject_id, count(*) AS n, max(t_us) // {ROW} + 1 AS rows FROM sig GROUP BY 1 HAVING count(*) >= 2),
g AS (SELECT subject_id, n, unnest(range(0, rows)) AS j, rows FROM n), h AS (SELECT *, j * (n - 1) / greatest(rows - 1, 1)::DOUBLE AS x FROM g), f AS (SELECT *, CAST(floor(x) AS BIGINT) AS i FROM h)
SELECT f.subject_id, 'rate' AS name, CAST(f.j AS INT) AS row, round(a.v + (x - f.i) * (b.v - a.v), 6) AS v FROM f JOIN i a USING (subject_id, i) JOIN i b ON b.subject_id = f.subject_id AND b.i = least(f.i + 1, n - 1)""")
def x2(spark, sf):
    s = sig(spark, sf)
    night = s.groupBy("subject_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_us", "v"))), lambda p: p["v"]).alias("samples"), (F.floor(F.max("t_us") / ROW) + 1).alias("rows"))
    arrays = night.select("subject_id", F.explode(F.array(F.lit("rate"), F.lit("peak_width"))).alias("name"), "samples")
    return markers.array_features(arrays, night.select("subject_id", "rows")).select("subject_id", "name", "row", r6("v"))
