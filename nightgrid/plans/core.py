"""Queries of the relational core: bins, joins, windows, runs, sets (survey 2.2-2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.operators import asof, binning, intervals, rolling, runs

from .adapter import EPISODES, EPOCH, PAIRS, ROW, ROWS6, SIG, STAGES, UNIT, episodes, pairs, rows6, sig, table
from .registry import query, r6

def W():  # noqa: N802
    return Window.partitionBy("subject_id").orderBy("slot")


def T():  # noqa: N802
    return Window.partitionBy("subject_id").orderBy("t_us")



# --- aggregation -------------------------------------------------------------------------------------------------


@query("a1_time_bin_mean", f"""WITH {ROWS6}, f AS (SELECT subject_id, min(slot) FILTER (v IS NOT NULL) AS lo, max(slot) FILTER (v IS NOT NULL) AS hi FROM rows6 GROUP BY 1)
SELECT r.subject_id, r.slot AS "row", round(CASE WHEN r.slot < lo AND r.slot >= lo - 5 THEN a.v WHEN r.slot > hi AND r.slot <= hi + 5 THEN z.v ELSE r.v END, 6) AS v
FROM rows6 r JOIN f USING (subject_id) LEFT JOIN rows6 a ON a.subject_id = r.subject_id AND a.slot = lo LEFT JOIN rows6 z ON z.subject_id = r.subject_id AND z.slot = hi""")
def a1(spark, sf):
    return binning.binned_on_spine(sig(spark, sf), ROW, UNIT).select("subject_id", "row", r6("v"))


@query("a1_time_bin_max", f"WITH {ROWS6}, x AS (SELECT subject_id, t_us // {ROW} AS slot, max(CASE WHEN v > 50 THEN 1.0 ELSE 0.0 END) AS v FROM sig GROUP BY 1, 2) SELECT sp.subject_id, sp.slot AS \"row\", x.v FROM sp LEFT JOIN x USING (subject_id, slot)")
def a1_max(spark, sf):
    return binning.binned_on_spine(sig(spark, sf).withColumn("v", F.when(F.col("v") > 50, 1.0).otherwise(0.0)), ROW, UNIT, reducer="max")


@query("a2_windowed_mode", f"WITH {ROWS6} SELECT subject_id, slot, stage FROM m")
def a2(spark, sf):
    s = sig(spark, sf).withColumn("slot", F.floor(F.col("t_us") / ROW).cast("long"))
    return binning.windowed_mode(s, "stage", ["subject_id", "slot"])


@query("a3_track_downsample", f"WITH {ROWS6} SELECT subject_id, slot // 5 AS block, round(avg(v), 6) AS v, count(*) AS n FROM rows6 GROUP BY 1, 2")
def a3(spark, sf):
    return binning.block_reduce(rows6(spark, sf), "slot", 5, {"v": F.avg("v"), "n": F.count("*")}, full_only=False).select("subject_id", "block", r6("v"), "n")


@query("a4_resample_linear", f"""WITH {SIG}, i AS (SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY t_us) - 1 AS i, v FROM sig), n AS (SELECT subject_id, max(i) AS m FROM i GROUP BY 1),
g AS (SELECT subject_id, j, j * m / 20.0 AS x FROM n, range(21) t(j)), h AS (SELECT *, CAST(floor(x) AS BIGINT) AS i FROM g)
SELECT h.subject_id, CAST(h.j AS INT) AS j, round(a.v + CASE WHEN x - h.i > 0 THEN (x - h.i) * (b.v - a.v) ELSE 0 END, 6) AS v FROM h LEFT JOIN i a USING (subject_id, i) LEFT JOIN i b ON b.subject_id = h.subject_id AND b.i = h.i + 1""")
def a4(spark, sf):
    s = sig(spark, sf).withColumn("i", F.row_number().over(T()) - 1)
    return binning.resample_linear(s, "i", "v", 21).select("subject_id", "j", r6("v"))


@query("a5_block_max", f"WITH {SIG}, i AS (SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY t_us) - 1 AS i, v FROM sig) SELECT subject_id, i // 8 AS block, max(v) AS v FROM i GROUP BY 1, 2 HAVING count(*) = 8")
def a5(spark, sf):
    s = sig(spark, sf).withColumn("i", F.row_number().over(T()) - 1)
    return binning.block_reduce(s, "i", 8, {"v": F.max("v")})


@query("a6_block_mean_var", f"WITH {SIG}, i AS (SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY t_us) - 1 AS i, v FROM sig) SELECT subject_id, i // 8 AS block, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS var FROM i GROUP BY 1, 2 HAVING count(*) = 8")
def a6(spark, sf):
    s = sig(spark, sf).withColumn("i", F.row_number().over(T()) - 1)
    return binning.block_reduce(s, "i", 8, {"mean": F.avg("v"), "var": F.var_pop("v")}).select("subject_id", "block", r6("mean"), r6("var"))


EPOCHS = f"""{ROWS6}, p AS (SELECT *, (row_number() OVER (PARTITION BY subject_id ORDER BY slot) - 1) // 5 AS blk FROM {{src}}),
g AS (SELECT subject_id, blk, min(slot) AS lo, avg(v) AS v FROM p GROUP BY 1, 2 HAVING count(*) = 5 AND min(slot) % 5 = 0 AND max(slot) - min(slot) = 4),
q AS (SELECT subject_id, blk, stage, count(*) AS n FROM p WHERE stage >= 0 GROUP BY 1, 2, 3),
l AS (SELECT subject_id, blk, min(stage) AS stage FROM (SELECT *, max(n) OVER (PARTITION BY subject_id, blk) AS mx FROM q) WHERE n = mx GROUP BY 1, 2)"""
LAB = EPOCHS.replace("{src}", "rows6")
GAPPY = EPOCHS.replace("{src}", "(SELECT * FROM rows6 WHERE slot % 17 <> 3)")


@query("a7_staging_windows", f"WITH {LAB} SELECT subject_id, lo // 5 AS epoch_index, round(v, 6) AS v, stage FROM g JOIN l USING (subject_id, blk)")
def a7(spark, sf):
    return binning.centred_epochs(rows6(spark, sf), "slot", "stage", ["v"]).select("subject_id", "epoch_index", r6("v"), "stage")


@query("a8_labelled_epochs_with_gaps", f"WITH {GAPPY} SELECT subject_id, lo // 5 AS epoch_index, round(v, 6) AS v, stage FROM g JOIN l USING (subject_id, blk)")
def a8(spark, sf):
    return binning.centred_epochs(rows6(spark, sf).filter("slot % 17 <> 3"), "slot", "stage", ["v"]).select("subject_id", "epoch_index", r6("v"), "stage")


@query("a9_epoch_median", f"WITH {SIG} SELECT subject_id, t_us // {EPOCH} AS epoch_index, round(median(v), 6) AS v FROM sig GROUP BY 1, 2")
def a9(spark, sf):
    return sig(spark, sf).groupBy("subject_id", F.floor(F.col("t_us") / EPOCH).cast("long").alias("epoch_index")).agg(r6(F.percentile("v", F.lit(0.5)), "v"))


@query("a10_stage_quantiles", f"WITH {SIG} SELECT stage, count(*) AS n, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.9), 6) AS p90 FROM sig GROUP BY 1")
def a10(spark, sf):
    # counts per distinct value travel, not rows; percentiles stay exact
    q = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    return sig(spark, sf).groupBy("stage").agg(F.count("*").alias("n"), *[r6(F.percentile("v", F.lit(x)), k) for k, x in q.items()])


@query("a11_mean_importance_top", f"WITH {SIG} SELECT stage, round(avg(v), 6) AS importance FROM sig GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def a11(spark, sf):
    return sig(spark, sf).groupBy("stage").agg(r6(F.avg("v"), "importance")).orderBy(F.desc("importance"), "stage").limit(3)


@query("a12_fold_summary", f"WITH {SIG} SELECT subject_id % 5 AS fold, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(median(v), 6) AS median FROM sig GROUP BY 1")
def a12(spark, sf):
    return sig(spark, sf).groupBy((F.col("subject_id") % 5).alias("fold")).agg(r6(F.avg("v"), "mean"), r6(F.stddev_pop("v"), "std"), r6(F.percentile("v", F.lit(0.5)), "median"))


@query("a13_beat_histogram", f"WITH {SIG} SELECT subject_id, t_us // {10 * UNIT} AS bin, count(*) AS n, round(avg(v), 6) AS rate FROM sig GROUP BY 1, 2")
def a13(spark, sf):
    return sig(spark, sf).groupBy("subject_id", F.floor(F.col("t_us") / (10 * UNIT)).cast("long").alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("v"), "rate"))


@query("a14_bad_share_per_epoch", f"WITH {ROWS6} SELECT subject_id, slot, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY subject_id, slot // 5), 6) AS bad_share FROM rows6")
def a14(spark, sf):
    r = rows6(spark, sf).withColumn("e", F.floor(F.col("slot") / 5))
    return r.select("subject_id", "slot", r6(F.avg(F.col("v").isNull().cast("double")).over(Window.partitionBy("subject_id", "e")), "bad_share"))


@query("a15_epoch_quality", f"WITH {ROWS6} SELECT subject_id, slot // 5 AS epoch_index, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 6) AS bad, count(v) = 0 AS all_flat FROM rows6 GROUP BY 1, 2 HAVING count(*) = 5")
def a15(spark, sf):
    g = binning.block_reduce(rows6(spark, sf), "slot", 5, {"bad": F.avg(F.col("v").isNull().cast("double")), "all_flat": F.count("v") == 0})
    return g.select("subject_id", F.col("block").alias("epoch_index"), r6("bad"), "all_flat")


@query("a16_exclusion_stats", f"WITH {ROWS6} SELECT stage, count(*) AS n, round(100.0 * avg(CASE WHEN v < 20 THEN 1.0 ELSE 0.0 END), 6) AS pct_low, count(DISTINCT subject_id) AS subjects FROM rows6 WHERE stage >= 0 GROUP BY 1")
def a16(spark, sf):
    r = rows6(spark, sf).filter("stage >= 0")
    return r.groupBy("stage").agg(F.count("*").alias("n"), r6(100 * F.avg(F.when(F.col("v") < 20, 1.0).otherwise(0.0)), "pct_low"), F.countDistinct("subject_id").alias("subjects"))


@query("a17_track_means", f"WITH {SIG} SELECT subject_id, round(avg(v), 6) AS v, round(avg(k), 6) AS k, count(*) AS n FROM sig GROUP BY 1")
def a17(spark, sf):
    return sig(spark, sf).groupBy("subject_id").agg(r6(F.avg("v"), "v"), r6(F.avg("k"), "k"), F.count("*").alias("n"))


RR = f"{SIG}, rr AS (SELECT subject_id, t_us, (t_us - lag(t_us) OVER (PARTITION BY subject_id ORDER BY t_us)) / {UNIT}.0 AS rr FROM sig)"


def with_rr(spark, sf):
    return sig(spark, sf).withColumn("rr", (F.col("t_us") - F.lag("t_us").over(T())) / float(UNIT)).filter("rr IS NOT NULL")


@query("a18_rr_summary", f"WITH {RR} SELECT subject_id, count(*) AS n, round(avg(CASE WHEN rr < 1 THEN 1.0 ELSE 0.0 END), 6) AS short, round(avg(CASE WHEN rr > 24 THEN 1.0 ELSE 0.0 END), 6) AS long, round(min(rr), 6) AS lo, round(max(rr), 6) AS hi FROM rr WHERE rr IS NOT NULL GROUP BY 1")
def a18(spark, sf):
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return with_rr(spark, sf).groupBy("subject_id").agg(F.count("*").alias("n"), r6(share(F.col("rr") < 1), "short"), r6(share(F.col("rr") > 24), "long"), r6(F.min("rr"), "lo"), r6(F.max("rr"), "hi"))


@query("a19_quantile_summary", f"WITH {SIG} SELECT round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.95), 6) AS q95, round(quantile_cont(v, 0.99), 6) AS q99, max(v) AS hi FROM sig")
def a19(spark, sf):
    return sig(spark, sf).agg(*[r6(F.percentile("v", F.lit(q)), n) for n, q in (("q50", 0.5), ("q95", 0.95), ("q99", 0.99))], F.max("v").alias("hi"))


@query("a20_category_share", "SELECT event_type, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM events GROUP BY 1")
def a20(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return g.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy()), "share"))  # one row per type


# --- joins -------------------------------------------------------------------------------------------------------

OVER = 'EXISTS (SELECT 1 FROM z WHERE z.subject_id = a.subject_id AND a.start <= z."end" AND a."end" >= z.start)'


@query("j1_interval_semi_join", f'WITH {EPISODES} SELECT subject_id, id, start, "end" FROM a WHERE {OVER}')
def j1(spark, sf):
    a, b = episodes(spark, sf)
    return intervals.overlap_semi(a, b, "id", bucket=64)


@query("j2_interval_anti_join", f'WITH {EPISODES} SELECT subject_id, id, start, "end" FROM a WHERE NOT {OVER}')
def j2(spark, sf):
    a, b = episodes(spark, sf)
    return intervals.overlap_anti(a, b, "id", bucket=64)


@query("j3_window_overlap_extended", f'WITH {EPISODES} SELECT subject_id, id FROM a WHERE EXISTS (SELECT 1 FROM z WHERE z.subject_id = a.subject_id AND a.start <= z."end" + 3 AND a."end" >= z.start)')
def j3(spark, sf):
    a, b = episodes(spark, sf)
    return intervals.overlap_semi(a, b.withColumn("end", F.col("end") + 3), "id", bucket=64).select("subject_id", "id")


@query("j4_events_in_window", f'WITH {EPISODES} SELECT subject_id, id, start, "end" FROM a WHERE "end" >= 100 AND start <= 400')
def j4(spark, sf):
    return intervals.in_window(episodes(spark, sf)[0], 100, 400)


@query("j5_event_row_mask", f'WITH {EPISODES}, n AS (SELECT subject_id, max("end") // 7 + 1 AS n FROM a GROUP BY 1), h AS (SELECT subject_id, unnest(range(greatest(start // 7, 0), least("end" // 7, n - 1) + 1)) AS "row" FROM a JOIN n USING (subject_id)) SELECT subject_id, "row", count(*) AS events FROM h GROUP BY 1, 2')
def j5(spark, sf):
    a, _ = episodes(spark, sf)
    n = a.groupBy("subject_id").agg((F.floor(F.max("end") / 7) + 1).alias("n"))
    return intervals.event_rows(a, 7, n).groupBy("subject_id", "row").agg(F.count("*").alias("events"))


@query("j6_truth_tracks", f'WITH {EPISODES}, n AS (SELECT subject_id, max("end") // 7 + 1 AS n FROM a GROUP BY 1), h AS (SELECT subject_id, id, unnest(range(start // 7, "end" // 7 + 1)) AS "row" FROM a), p AS (SELECT subject_id, "row", max(id) AS id FROM h GROUP BY 1, 2), s AS (SELECT subject_id, unnest(range(0, n)) AS "row" FROM n) SELECT s.subject_id, s."row", coalesce(p.id % 4 + 1, 0) AS code FROM s LEFT JOIN p USING (subject_id, "row")')
def j6(spark, sf):
    a, _ = episodes(spark, sf)
    n = a.groupBy("subject_id").agg((F.floor(F.max("end") / 7) + 1).alias("n"))
    return intervals.painted(a.withColumn("code", F.col("id") % 4 + 1), "code", "id", 7, n)


@query("j7_label_attach", f"WITH {ROWS6} SELECT r.subject_id, r.slot, CASE WHEN r.v IS NULL THEN -1 ELSE r.stage END AS stage, CASE r.stage WHEN 0 THEN 'wake' WHEN 1 THEN 'n1' WHEN 2 THEN 'n2' WHEN 3 THEN 'n3' WHEN 4 THEN 'rem' ELSE 'unknown' END AS stage_name FROM rows6 r")
def j7(spark, sf):
    name = F.element_at(F.create_map(*[F.lit(x) for p in enumerate(["wake", "n1", "n2", "n3", "rem"]) for x in p]), F.col("stage"))
    return rows6(spark, sf).select("subject_id", "slot", F.when(F.col("v").isNull(), -1).otherwise(F.col("stage")).alias("stage"), F.coalesce(name, F.lit("unknown")).alias("stage_name"))


@query("j8_event_fraction", f"WITH {ROWS6} SELECT subject_id, slot // 5 AS epoch_index, round(avg(CASE WHEN stage = 4 THEN 1.0 ELSE 0.0 END), 6) AS fraction, max(CASE WHEN stage = 4 THEN 1 ELSE 0 END) AS mask FROM rows6 GROUP BY 1, 2")
def j8(spark, sf):
    hit = F.when(F.col("stage") == 4, 1.0).otherwise(0.0)
    return rows6(spark, sf).groupBy("subject_id", F.floor(F.col("slot") / 5).cast("long").alias("epoch_index")).agg(r6(F.avg(hit), "fraction"), F.max(hit).cast("int").alias("mask"))


@query("j9_prediction_update", f"WITH {PAIRS} SELECT p.event_id, coalesce(u.pred, p.truth) AS y FROM pairs p LEFT JOIN (SELECT event_id, pred FROM pairs WHERE v >= 30) u USING (event_id)")
def j9(spark, sf):
    p = pairs(spark, sf)
    u = p.filter("v >= 30").select("event_id", F.col("pred").alias("new"))
    return p.join(u, "event_id", "left").select("event_id", F.coalesce("new", "truth").alias("y"))


@query("j10_expert_inner_chain", f"WITH {PAIRS} SELECT a.event_id, a.truth AS e1, b.pred AS e2, c.truth AS e3 FROM pairs a JOIN pairs b USING (event_id) JOIN pairs c USING (event_id) WHERE a.truth <> 4 AND b.v >= 30")
def j10(spark, sf):
    p = pairs(spark, sf)
    a = p.filter("truth <> 4").select("event_id", F.col("truth").alias("e1"))
    b = p.filter("v >= 30").select("event_id", F.col("pred").alias("e2"))
    return a.join(b, "event_id").join(p.select("event_id", F.col("truth").alias("e3")), "event_id")


@query("j11_signal_expert_outer", f"WITH {PAIRS} SELECT event_id, a.truth AS e1, b.pred AS e2 FROM (SELECT * FROM pairs WHERE truth <> 4) a FULL JOIN (SELECT * FROM pairs WHERE v >= 30) b USING (event_id)")
def j11(spark, sf):
    p = pairs(spark, sf)
    return p.filter("truth <> 4").select("event_id", F.col("truth").alias("e1")).join(p.filter("v >= 30").select("event_id", F.col("pred").alias("e2")), "event_id", "full")


@query("j12_epoch_feature_joins", f"WITH {SIG}, e AS (SELECT subject_id, t_us // {EPOCH} AS epoch_index, median(v) AS med, avg(k) AS mean FROM sig GROUP BY 1, 2), b AS (SELECT subject_id, t_us // {EPOCH} AS epoch_index, count(*) AS bursts FROM sig WHERE v > 80 GROUP BY 1, 2) SELECT e.subject_id, e.epoch_index, round(med, 6) AS med, round(mean, 6) AS mean, coalesce(bursts, 0) AS bursts FROM e LEFT JOIN b USING (subject_id, epoch_index)")
def j12(spark, sf):
    s = sig(spark, sf).withColumn("epoch_index", F.floor(F.col("t_us") / EPOCH).cast("long"))
    # one pass: the bursts are a conditional count, no second scan or join
    return s.groupBy("subject_id", "epoch_index").agg(r6(F.percentile("v", F.lit(0.5)), "med"), r6(F.avg("k"), "mean"), F.count_if(F.col("v") > 80).alias("bursts"))


@query("j13_quality_left_join", f"WITH {ROWS6}, q AS (SELECT subject_id, slot, true AS bad FROM rows6 WHERE v < 10) SELECT r.subject_id, r.slot, coalesce(q.bad, false) AS bad FROM rows6 r LEFT JOIN q USING (subject_id, slot)")
def j13(spark, sf):
    r = rows6(spark, sf)
    q = r.filter("v < 10").select("subject_id", "slot", F.lit(True).alias("bad"))
    return r.join(q, ["subject_id", "slot"], "left").select("subject_id", "slot", F.coalesce("bad", F.lit(False)).alias("bad"))


@query("j14_asof_anchor", f"WITH {SIG}, t AS (SELECT * FROM sig WHERE stage = 0), p AS (SELECT * FROM sig WHERE stage = 4) SELECT p.event_id, t.t_us AS trough_us, round(t.v, 6) AS trough FROM p ASOF LEFT JOIN t ON p.subject_id = t.subject_id AND p.t_us >= t.t_us")
def j14(spark, sf):
    s = sig(spark, sf)
    x = asof.with_neighbours(s.filter("stage = 4").select("subject_id", "t_us", "event_id"), s.filter("stage = 0"), "t_us", "v")
    return x.select("event_id", F.col("prev_t").alias("trough_us"), r6("prev_v", "trough"))


@query("j15_neighbour_mean", f"""WITH {ROWS6}, x AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY subject_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
first_value(v IGNORE NULLS) OVER (PARTITION BY subject_id ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM rows6) SELECT subject_id, slot, round(coalesce(v, (p + n) / 2, p, n), 6) AS filled FROM x""")
def j15(spark, sf):
    r = rows6(spark, sf).withColumn("good", F.col("v").isNotNull())
    return asof.neighbour_mean(r, "slot", "v", "good").select("subject_id", "slot", r6("filled"))


GRID = f"{SIG}, g AS (SELECT subject_id, unnest(range(0, 721, 12)) * {UNIT} AS t_us FROM (SELECT DISTINCT subject_id FROM sig)), pn AS (SELECT g.subject_id, g.t_us, p.t_us AS pt, p.v AS pv FROM g ASOF LEFT JOIN sig p ON g.subject_id = p.subject_id AND g.t_us >= p.t_us), nn AS (SELECT g.subject_id, g.t_us, p.t_us AS nt, p.v AS nv FROM g ASOF LEFT JOIN sig p ON g.subject_id = p.subject_id AND g.t_us <= p.t_us), w AS (SELECT * FROM pn JOIN nn USING (subject_id, t_us))"


def grid(spark, sf):
    return sig(spark, sf).select("subject_id").distinct().select("subject_id", F.explode(F.expr(f"transform(sequence(0L, 720L, 12L), x -> x * {UNIT})")).alias("t_us"))


LIN = "CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv WHEN nt = pt THEN pv ELSE pv + (nv - pv) * ((t_us - pt) / CAST(nt - pt AS DOUBLE)) END"


@query("j16_nearest_on_grid", f"WITH {GRID} SELECT subject_id, t_us, CASE WHEN pt IS NULL OR nt IS NULL THEN NULL WHEN t_us - pt <= nt - t_us THEN pv ELSE nv END AS v FROM w")
def j16(spark, sf):
    return asof.nearest(grid(spark, sf), sig(spark, sf), "t_us", "v").select("subject_id", "t_us", "v")


@query("j17_linear_on_grid", f"WITH {GRID} SELECT subject_id, t_us, round({LIN}, 6) AS v FROM w")
def j17(spark, sf):
    return asof.linear(grid(spark, sf), sig(spark, sf), "t_us", "v").select("subject_id", "t_us", r6("v"))


@query("j18_gap_limited_linear", f"WITH {GRID} SELECT subject_id, t_us, round(CASE WHEN least(t_us - pt, nt - t_us) <= {3 * UNIT} THEN {LIN} END, 6) AS v FROM w")
def j18(spark, sf):
    return asof.linear(grid(spark, sf), sig(spark, sf), "t_us", "v", max_gap=3 * UNIT).select("subject_id", "t_us", r6("v"))


@query("j20_second_scorer_lookup", f"WITH {PAIRS} SELECT a.event_id, coalesce(b.pred, -1) AS label2 FROM pairs a LEFT JOIN (SELECT * FROM pairs WHERE event_id % 4 <> 0) b USING (event_id)")
def j20(spark, sf):
    p = pairs(spark, sf)
    return p.select("event_id").join(p.filter("event_id % 4 <> 0").select("event_id", "pred"), "event_id", "left").select("event_id", F.coalesce("pred", F.lit(-1)).alias("label2"))


# --- windows -----------------------------------------------------------------------------------------------------

FR = "OVER (PARTITION BY subject_id ORDER BY slot ROWS BETWEEN {} AND {})"
FT = "OVER (PARTITION BY subject_id ORDER BY t_us ROWS BETWEEN {} AND {})"


@query("w1_rolling_median", f"WITH {SIG} SELECT event_id, round(quantile_cont(v, 0.5) {FT.format('8 PRECEDING', 'CURRENT ROW')}, 6) AS m FROM sig")
def w1(spark, sf):
    return sig(spark, sf).select("event_id", r6(rolling.rolling_median("v", rolling.trailing("t_us", 9)), "m"))


@query("w2_rolling_mean", f"WITH {SIG} SELECT event_id, round(avg(v) {FT.format('8 PRECEDING', 'CURRENT ROW')}, 6) AS m FROM sig")
def w2(spark, sf):
    return sig(spark, sf).select("event_id", r6(F.avg("v").over(rolling.trailing("t_us", 9)), "m"))


@query("w3_future_min", f"WITH {SIG} SELECT event_id, min(v) {FT.format('CURRENT ROW', '7 FOLLOWING')} AS m FROM sig")
def w3(spark, sf):
    return sig(spark, sf).select("event_id", F.min("v").over(rolling.by("t_us").rowsBetween(0, 7)).alias("m"))


C4 = FT.format("19 PRECEDING", "CURRENT ROW")


@query("w4_rolling_corr", f"WITH {SIG}, m AS (SELECT event_id, avg(v * k) {C4} - avg(v) {C4} * avg(k) {C4} AS cov, greatest(avg(v * v) {C4} - avg(v) {C4} * avg(v) {C4}, 0) AS vx, greatest(avg(k * k) {C4} - avg(k) {C4} * avg(k) {C4}, 0) AS vy, count(*) {C4} AS n FROM sig) SELECT event_id, round(CASE WHEN n >= 3 AND sqrt(vx * vy) > 1e-12 THEN least(greatest(cov / sqrt(vx * vy), -1), 1) END, 5) AS r FROM m")
def w4(spark, sf):
    w = rolling.trailing("t_us", 20)
    return sig(spark, sf).select("event_id", F.round(F.when(F.count("*").over(w) >= 3, rolling.rolling_corr("v", "k", w)), 5).alias("r"))


@query("w5_centred_median_min_count", f"WITH {ROWS6} SELECT subject_id, slot, round(CASE WHEN count(v) {FR.format('4 PRECEDING', '4 FOLLOWING')} >= 4 THEN quantile_cont(v, 0.5) {FR.format('4 PRECEDING', '4 FOLLOWING')} END, 6) AS m FROM rows6")
def w5(spark, sf):
    w = W().rowsBetween(-4, 4)
    return rows6(spark, sf).select("subject_id", "slot", r6(rolling.guarded(F.percentile("v", F.lit(0.5)), "v", w, 4), "m"))


@query("w6_trailing_mean_min_count", f"WITH {ROWS6} SELECT subject_id, slot, round(CASE WHEN count(v) {FR.format('4 PRECEDING', 'CURRENT ROW')} >= 4 THEN avg(v) {FR.format('4 PRECEDING', 'CURRENT ROW')} END, 6) AS m FROM rows6")
def w6(spark, sf):
    return rows6(spark, sf).select("subject_id", "slot", r6(rolling.guarded(F.avg("v"), "v", W().rowsBetween(-4, 0), 4), "m"))


@query("w7_closed_range_window", f"WITH {SIG} SELECT event_id, count(*) OVER w AS n, round(avg(v) OVER w, 6) AS m FROM sig WINDOW w AS (PARTITION BY subject_id ORDER BY t_us RANGE BETWEEN {15 * UNIT} PRECEDING AND {15 * UNIT} FOLLOWING)")
def w7(spark, sf):
    w = rolling.closed_range("t_us", 15 * UNIT)
    return sig(spark, sf).select("event_id", F.count("*").over(w).alias("n"), r6(F.avg("v").over(w), "m"))


@query("w8_windowed_cv", f"WITH {GRID}, c AS (SELECT g.subject_id, g.t_us, count(s.v) AS n, avg(s.v) AS m, stddev_samp(s.v) AS sd FROM g LEFT JOIN sig s ON s.subject_id = g.subject_id AND s.t_us >= g.t_us - {72 * UNIT} AND s.t_us < g.t_us + {72 * UNIT} GROUP BY 1, 2) SELECT subject_id, t_us, round(CASE WHEN n >= 5 AND m > 0 THEN sd / m END, 6) AS cv FROM c")
def w8(spark, sf):
    x = rolling.at_grid(sig(spark, sf), grid(spark, sf), "t_us", "v", 72 * UNIT, {"n": F.count("v"), "m": F.avg("v"), "sd": F.stddev_samp("v")})
    return x.select("subject_id", "t_us", r6(F.when((F.col("n") >= 5) & (F.col("m") > 0), F.col("sd") / F.col("m")), "cv"))


@query("w9_lag_features", f"WITH {SIG} SELECT event_id, lag(v) OVER (PARTITION BY subject_id ORDER BY t_us) AS v__prev1, lag(k) OVER (PARTITION BY subject_id ORDER BY t_us) AS k__prev1 FROM sig")
def w9(spark, sf):
    return rolling.lag_features(sig(spark, sf), "t_us", ["v", "k"], [1]).select("event_id", "v__prev1", "k__prev1")


@query("w11_scatter_fill", f"WITH {ROWS6} SELECT subject_id, slot, round(coalesce(last_value(v IGNORE NULLS) {FR.format('UNBOUNDED PRECEDING', 'CURRENT ROW')}, first_value(v IGNORE NULLS) {FR.format('CURRENT ROW', 'UNBOUNDED FOLLOWING')}), 6) AS filled FROM rows6")
def w11(spark, sf):
    return asof.fill_forward(rows6(spark, sf), "slot", "v").select("subject_id", "slot", r6("filled"))


@query("w12_linear_fill", f"""WITH {ROWS6}, k AS (SELECT subject_id, slot, v FROM rows6 WHERE v IS NOT NULL), p AS (SELECT r.subject_id, r.slot, k.slot AS pt, k.v AS pv FROM rows6 r ASOF LEFT JOIN k ON r.subject_id = k.subject_id AND r.slot >= k.slot),
n AS (SELECT r.subject_id, r.slot, k.slot AS nt, k.v AS nv FROM rows6 r ASOF LEFT JOIN k ON r.subject_id = k.subject_id AND r.slot <= k.slot)
SELECT subject_id, slot, round(coalesce({LIN.replace('t_us', 'slot')}, 0), 6) AS v FROM p JOIN n USING (subject_id, slot)""")
def w12(spark, sf):
    r = rows6(spark, sf)
    x = asof.linear(r.select("subject_id", "slot"), r.select("subject_id", "slot", "v"), "slot", "v")
    return x.select("subject_id", "slot", r6(F.coalesce("v", F.lit(0.0)), "v"))


RUNS = f"{ROWS6}, x AS (SELECT *, CASE WHEN v > 50 THEN 1 ELSE 0 END AS hi FROM rows6), y AS (SELECT *, slot - row_number() OVER (PARTITION BY subject_id, hi ORDER BY slot) AS g FROM x), r AS (SELECT subject_id, hi, min(slot) AS start, count(*) AS length FROM y GROUP BY subject_id, hi, g)"


def hi_rows(spark, sf):
    return rows6(spark, sf).withColumn("hi", F.when(F.col("v") > 50, 1).otherwise(0))


@query("w13_runs", f"WITH {RUNS} SELECT subject_id, start, length FROM r WHERE hi = 1")
def w13(spark, sf):
    return runs.runs(hi_rows(spark, sf), "hi", "slot", only=1).drop("hi")


@query("w14_expand_runs", f"WITH {RUNS} SELECT subject_id, slot AS \"row\" FROM x WHERE hi = 1")
def w14(spark, sf):
    h = hi_rows(spark, sf)
    return runs.expand_runs(runs.runs(h, "hi", "slot", only=1), h.groupBy("subject_id").agg((F.max("slot") + 1).alias("n")))


@query("w15_bouts", f"WITH {ROWS6}, y AS (SELECT *, slot - row_number() OVER (PARTITION BY subject_id, stage ORDER BY slot) AS g FROM rows6) SELECT subject_id, stage, min(slot) AS start, count(*) AS length FROM y GROUP BY subject_id, stage, g")
def w15(spark, sf):
    return runs.runs(rows6(spark, sf), "stage", "slot")


@query("w16_run_length_per_row", f"WITH {RUNS} SELECT subject_id, slot, count(*) OVER (PARTITION BY subject_id, hi, g) AS run_length FROM y")
def w16(spark, sf):
    return runs.run_length_per_row(hi_rows(spark, sf), "hi", "slot").select("subject_id", "slot", "run_length")


@query("w17_longest_runs", f"WITH {RUNS}, k AS (SELECT subject_id, start, length, row_number() OVER (PARTITION BY subject_id ORDER BY length DESC, start) AS rank FROM r WHERE hi = 1) SELECT * FROM k WHERE rank <= 3")
def w17(spark, sf):
    return runs.longest_runs(runs.runs(hi_rows(spark, sf), "hi", "slot", only=1), 3).drop("hi")


@query("w18_transition_rows", f"WITH {PAIRS}, x AS (SELECT *, lag(truth) OVER w AS before, t_us - lag(t_us) OVER w AS gap FROM pairs WINDOW w AS (PARTITION BY subject_id ORDER BY t_us)) SELECT event_id, before <> truth AS changed, truth = pred AS correct FROM x WHERE gap <= {6 * UNIT}")
def w18(spark, sf):
    x = pairs(spark, sf).withColumns({"before": F.lag("truth").over(T()), "gap": F.col("t_us") - F.lag("t_us").over(T())}).filter(F.col("gap") <= 6 * UNIT)
    return x.select("event_id", (F.col("before") != F.col("truth")).alias("changed"), (F.col("truth") == F.col("pred")).alias("correct"))


@query("w19_centred_jump", f"WITH {SIG}, a AS (SELECT *, quantile_cont(v, 0.5) {FT.format('15 PRECEDING', '15 FOLLOWING')} AS med, list(v) {FT.format('15 PRECEDING', '15 FOLLOWING')} AS al FROM sig), b AS (SELECT *, 1.4826 * list_aggregate(list_transform(al, lambda x: abs(x - med)), 'median') AS sd FROM a) SELECT event_id, sd > 0 AND v > med + 1.5 * sd AS jump FROM b")
def w19(spark, sf):
    return rolling.centred_jump(sig(spark, sf), "t_us", "v", 15, 1.5).select("event_id", "jump")


@query("w20_robust_threshold", f"WITH {SIG}, m AS (SELECT subject_id, median(v) AS med FROM sig GROUP BY 1), d AS (SELECT subject_id, median(abs(v - med)) AS mad FROM sig JOIN m USING (subject_id) GROUP BY 1) SELECT event_id, v > med + 1.0 * 1.4826 * mad AS above FROM sig JOIN m USING (subject_id) JOIN d USING (subject_id)")
def w20(spark, sf):
    return rolling.robust_threshold(sig(spark, sf), "v", 1.0).select("event_id", "above")


@query("w21_bursts_per_epoch", f"WITH {SIG}, m AS (SELECT subject_id, median(v) AS med FROM sig GROUP BY 1), d AS (SELECT subject_id, median(abs(v - med)) AS mad FROM sig JOIN m USING (subject_id) GROUP BY 1) SELECT subject_id, t_us // {EPOCH} AS epoch_index, count(*) FILTER (v > med + 1.0 * 1.4826 * mad) AS bursts FROM sig JOIN m USING (subject_id) JOIN d USING (subject_id) GROUP BY 1, 2")
def w21(spark, sf):
    x = rolling.robust_threshold(sig(spark, sf), "v", 1.0)
    return x.groupBy("subject_id", F.floor(F.col("t_us") / EPOCH).cast("long").alias("epoch_index")).agg(F.count_if("above").alias("bursts"))


@query("w22_percentile_rank_pick", f"WITH {SIG}, r AS (SELECT subject_id, event_id, stage, (rank() OVER (PARTITION BY stage ORDER BY v) + (count(*) OVER (PARTITION BY stage, v) - 1) / 2.0) / count(*) OVER (PARTITION BY stage) AS pct FROM sig), p AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY abs(pct - 0.9), event_id) AS rn FROM r) SELECT stage, event_id, round(pct, 6) AS pct FROM p WHERE rn = 1")
def w22(spark, sf):
    s = sig(spark, sf)
    n = s.groupBy("stage").agg(F.count("*").alias("n"))
    x = s.join(rolling.rank_table(s, "v", ("stage",)), ["stage", "v"]).join(F.broadcast(n), "stage").withColumn("pct", F.col("rank") / F.col("n"))  # n: one row per stage
    x = x.groupBy("stage").agg(F.min_by(F.struct("event_id", "pct"), F.struct(F.abs(F.col("pct") - 0.9), "event_id")).alias("b")).select("stage", "b.*")
    return x.select("stage", "event_id", r6("pct"))


@query("w23_block_means_at_offsets", f"WITH {ROWS6} SELECT subject_id, slot, round(avg(v) {FR.format('6 PRECEDING', '2 PRECEDING')}, 6) AS before, round(avg(v) {FR.format('2 FOLLOWING', '6 FOLLOWING')}, 6) AS after FROM rows6")
def w23(spark, sf):
    return rows6(spark, sf).select("subject_id", "slot", r6(rolling.block_mean_at(None, "slot", "v", -6, -2), "before"), r6(rolling.block_mean_at(None, "slot", "v", 2, 6), "after"))


SEGS = f"{ROWS6}, u AS (SELECT *, slot - row_number() OVER (PARTITION BY subject_id ORDER BY slot) AS g FROM rows6 WHERE slot % 17 <> 3), s AS (SELECT *, row_number() OVER (PARTITION BY subject_id, g ORDER BY slot) AS rn, count(*) OVER f AS n, avg(v) OVER f AS m, sum(CASE WHEN stage = 4 THEN 1 ELSE 0 END) OVER f AS ev, lead(stage) OVER (PARTITION BY subject_id, g ORDER BY slot) AS anchor FROM u WINDOW f AS (PARTITION BY subject_id, g ORDER BY slot ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING))"


def sliding(spark, sf, stride):
    aggs = {"m": F.avg("v"), "events": F.sum(F.when(F.col("stage") == 4, 1).otherwise(0)), "labels": F.collect_list("stage")}
    x = rolling.sliding_slots(rows6(spark, sf).filter("slot % 17 <> 3"), "slot", 11, stride, aggs)
    return x.select("subject_id", "start_slot", r6("m"), "events", F.get("labels", F.lit(1)).alias("anchor"))


@query("w24_sliding_windows", f"WITH {SEGS} SELECT subject_id, slot AS start_slot, round(m, 6) AS m, CAST(ev AS BIGINT) AS events, anchor FROM s WHERE n = 11")
def w24(spark, sf):
    return sliding(spark, sf, 1)


@query("w25_sliding_stride", f"WITH {SEGS} SELECT subject_id, slot AS start_slot, round(m, 6) AS m, CAST(ev AS BIGINT) AS events, anchor FROM s WHERE n = 11 AND (rn - 1) % 3 = 0")
def w25(spark, sf):
    return sliding(spark, sf, 3)


@query("w26_strided_segments", f"WITH {ROWS6}, n AS (SELECT subject_id, max(slot) + 1 AS n FROM rows6 GROUP BY 1), s AS (SELECT subject_id, n, unnest(range(0, n, 5)) AS start FROM n) SELECT subject_id, start, start + 10 AS stop FROM s WHERE start + 10 <= n")
def w26(spark, sf):
    n = rows6(spark, sf).groupBy("subject_id").agg((F.max("slot") + 1).alias("n")).filter("n >= 10")
    return n.select("subject_id", F.explode(F.expr("sequence(0L, n - 10, 5L)")).alias("start")).withColumn("stop", F.col("start") + 10)


@query("w27_average_ranks", f"WITH {SIG} SELECT event_id, rank() OVER (PARTITION BY subject_id ORDER BY k) + (count(*) OVER (PARTITION BY subject_id, k) - 1) / 2.0 AS rank FROM sig")
def w27(spark, sf):
    return sig(spark, sf).select("event_id", rolling.average_rank("k", ("subject_id",)).alias("rank"))


@query("w28_night_position", f"WITH {ROWS6} SELECT subject_id, slot, round((slot + 0.0) / count(*) OVER (PARTITION BY subject_id), 6) AS fraction, count(*) OVER (PARTITION BY subject_id) - slot - 1 AS remaining FROM rows6")
def w28(spark, sf):
    n = F.count("*").over(Window.partitionBy("subject_id"))
    return rows6(spark, sf).select("subject_id", "slot", r6(F.col("slot") / n, "fraction"), (n - F.col("slot") - 1).alias("remaining"))


# --- filters, sorts, sets ----------------------------------------------------------------------------------------


@query("p8_stable_stage", f"WITH {ROWS6}, x AS (SELECT *, lag(stage) OVER w AS a, lead(stage) OVER w AS b FROM rows6 WINDOW w AS (PARTITION BY subject_id ORDER BY slot)) SELECT subject_id, slot, stage FROM x WHERE a = stage AND b = stage AND stage >= 0")
def p8(spark, sf):
    x = rows6(spark, sf).withColumns({"a": F.lag("stage").over(W()), "b": F.lead("stage").over(W())})
    return x.filter("a = stage AND b = stage AND stage >= 0").select("subject_id", "slot", "stage")


@query("p9_signal_usable", f"WITH {SIG} SELECT subject_id, count(*) >= 40 AND count(DISTINCT round(v, 6)) >= 30 AND (quantile_cont(v, 0.99) - quantile_cont(v, 0.01)) / (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) < 40 AS usable FROM sig GROUP BY 1")
def p9(spark, sf):
    q = lambda p: F.percentile("v", F.lit(p))
    ok = (F.count("*") >= 40) & (F.count_distinct(F.round("v", 6)) >= 30) & (F.try_divide(q(0.99) - q(0.01), q(0.75) - q(0.25)) < 40)
    return sig(spark, sf).groupBy("subject_id").agg(ok.alias("usable"))


@query("p6_dropped_subjects", f"WITH {SIG} SELECT subject_id, count(*) AS n FROM sig WHERE subject_id NOT IN (2, 3, 5, 7) GROUP BY 1")
def p6(spark, sf):
    return sig(spark, sf).filter(~F.col("subject_id").isin(2, 3, 5, 7)).groupBy("subject_id").agg(F.count("*").alias("n"))


@query("p7_event_only", f"WITH {ROWS6} SELECT subject_id, slot, stage FROM rows6 WHERE stage > 0")
def p7(spark, sf):
    return rows6(spark, sf).filter("stage > 0").select("subject_id", "slot", "stage")


@query("p12_contiguous", f"WITH {ROWS6}, u AS (SELECT *, slot - lag(slot) OVER (PARTITION BY subject_id ORDER BY slot) AS d FROM rows6 WHERE slot % 17 <> 3) SELECT subject_id, slot FROM (SELECT subject_id, slot, max(abs(d - 1)) OVER (PARTITION BY subject_id ORDER BY slot ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS e FROM u) WHERE e = 0")
def p12(spark, sf):
    x = rows6(spark, sf).filter("slot % 17 <> 3").withColumn("d", F.abs(F.col("slot") - F.lag("slot").over(W()) - 1))
    return x.withColumn("e", F.max("d").over(W().rowsBetween(-4, 0))).filter("e = 0").select("subject_id", "slot")


@query("p4_clean_model_frame", f"WITH {ROWS6} SELECT subject_id, slot, round(v, 6) AS v, CAST(stage AS INT) AS target FROM rows6 WHERE stage >= 0 AND v IS NOT NULL")
def p4(spark, sf):
    return rows6(spark, sf).withColumn("v", binning.clean("v")).dropna(subset=["v"]).filter("stage >= 0").select("subject_id", "slot", r6("v"), F.col("stage").cast("int").alias("target"))


@query("s1_stable_sort_rank", f"WITH {SIG} SELECT event_id, row_number() OVER (PARTITION BY subject_id ORDER BY k, t_us) AS pos FROM sig")
def s1(spark, sf):
    return sig(spark, sf).select("event_id", F.row_number().over(Window.partitionBy("subject_id").orderBy("k", "t_us")).alias("pos"))


@query("s3_top_n_per_class", f"WITH {SIG}, r AS (SELECT stage, event_id, v, row_number() OVER (PARTITION BY stage ORDER BY v DESC, event_id) AS rank FROM sig) SELECT * FROM r WHERE rank <= 5")
def s3(spark, sf):
    w = Window.partitionBy("stage").orderBy(F.desc("v"), "event_id")
    return sig(spark, sf).select("stage", "event_id", "v", F.row_number().over(w).alias("rank")).filter("rank <= 5")


@query("s4_channel_ranking", f"WITH {SIG}, m AS (SELECT subject_id, median(v) AS med FROM sig GROUP BY 1), x AS (SELECT subject_id, stage, avg((v - med) * (v - med)) AS mse FROM sig JOIN m USING (subject_id) GROUP BY 1, 2) SELECT subject_id, arg_min(stage, mse) AS best FROM x GROUP BY 1")
def s4(spark, sf):
    s = sig(spark, sf)
    med = s.groupBy("subject_id").agg(F.percentile("v", F.lit(0.5)).alias("med"))
    x = s.join(med, "subject_id").groupBy("subject_id", "stage").agg(F.avg((F.col("v") - F.col("med")) ** 2).alias("mse"))
    return x.groupBy("subject_id").agg(F.min_by("stage", "mse").alias("best"))


@query("s5_ordered_label_union", f"WITH {SIG} SELECT subject_id, stage, min(t_us) AS first_us FROM sig GROUP BY 1, 2")
def s5(spark, sf):
    return sig(spark, sf).groupBy("subject_id", "stage").agg(F.min("t_us").alias("first_us"))


@query("s6_stable_unique", f"WITH {SIG}, r AS (SELECT *, row_number() OVER (PARTITION BY subject_id, k ORDER BY t_us) AS rn FROM sig) SELECT subject_id, k, event_id FROM r WHERE rn = 1")
def s6(spark, sf):
    return sig(spark, sf).groupBy("subject_id", "k").agg(F.min_by("event_id", "t_us").alias("event_id"))


@query("s7_union_all", f"WITH {SIG} SELECT subject_id, v, 'a' AS dataset FROM sig WHERE stage = 0 UNION ALL SELECT subject_id, NULL AS v, 'b' AS dataset FROM sig WHERE stage = 1")
def s7(spark, sf):
    s = sig(spark, sf)
    return s.filter("stage = 0").select("subject_id", "v", F.lit("a").alias("dataset")).unionByName(s.filter("stage = 1").select("subject_id", F.lit("b").alias("dataset")), allowMissingColumns=True)


@query("s8_set_difference", f"WITH {SIG} SELECT subject_id FROM sig WHERE stage = 0 EXCEPT SELECT subject_id FROM sig WHERE v > 250")
def s8(spark, sf):
    s = sig(spark, sf)
    return s.filter("stage = 0").select("subject_id").distinct().join(s.filter("v > 250").select("subject_id"), "subject_id", "left_anti")


@query("s9_stratified_sample", f"WITH {SIG}, r AS (SELECT stage, event_id, row_number() OVER (PARTITION BY stage ORDER BY md5('7:' || event_id), event_id) AS rn, count(*) OVER (PARTITION BY stage) AS n FROM sig) SELECT stage, event_id FROM r WHERE rn <= n // 20")
def s9(spark, sf):
    w = Window.partitionBy("stage")
    s = sig(spark, sf).withColumn("h", F.md5(F.concat(F.lit("7:"), F.col("event_id").cast("string")).cast("binary")))
    x = s.withColumns({"rn": F.row_number().over(w.orderBy("h", "event_id")), "n": F.count("*").over(w)})
    return x.filter("rn <= n div 20").select("stage", "event_id")


@query("flagship_subject_report", f"""WITH {RUNS}, bad AS (SELECT subject_id, start, start + length - 1 AS stop FROM (SELECT subject_id, min(slot) AS start, count(*) AS length FROM (SELECT *, slot - row_number() OVER (PARTITION BY subject_id ORDER BY slot) AS g2 FROM rows6 WHERE v IS NULL) GROUP BY subject_id, g2) WHERE length >= 4),
good AS (SELECT * FROM r WHERE hi = 1 AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.subject_id = r.subject_id AND r.start <= bad.stop + 1 AND r.start + r.length - 1 >= bad.start - 1))
SELECT s.subject_id, s.n_rows, coalesce(g.n_runs, 0) AS n_runs, coalesce(g.longest, 0) AS longest, s.mean FROM (SELECT subject_id, count(*) AS n_rows, round(avg(v), 6) AS mean FROM rows6 GROUP BY 1) s LEFT JOIN (SELECT subject_id, count(*) AS n_runs, max(length) AS longest FROM good GROUP BY 1) g USING (subject_id)""")
def flagship(spark, sf):
    """Bins, runs above a threshold, runs without data, overlap anti-join, one report line per subject."""
    r = hi_rows(spark, sf)
    span = lambda d: d.withColumn("end", F.col("start") + F.col("length") - 1)
    high = span(runs.runs(r, "hi", "slot", only=1)).withColumn("id", F.col("start"))
    bad = span(runs.runs(r.withColumn("none", F.col("v").isNull().cast("int")), "none", "slot", only=1)).filter("length >= 4").select("subject_id", (F.col("start") - 1).alias("start"), (F.col("end") + 1).alias("end"))
    good = intervals.overlap_anti(high, bad, "id", bucket=64).groupBy("subject_id").agg(F.count("*").alias("n_runs"), F.max("length").alias("longest"))
    base = r.groupBy("subject_id").agg(F.count("*").alias("n_rows"), r6(F.avg("v"), "mean"))
    return base.join(good, "subject_id", "left").select("subject_id", "n_rows", F.coalesce("n_runs", F.lit(0)).alias("n_runs"), F.coalesce("longest", F.lit(0)).alias("longest"), "mean")
