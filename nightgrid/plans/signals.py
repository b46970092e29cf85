"""Queries for kernels, generators, oxygen drops, models, streams (survey 2.7, 2.8, 2.10, 2.12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.functions import dsp, generators, spo2, table_functions
from nightgrid.operators import binning, decoders, runs
from nightgrid.sources.scratch import new_folder
from nightgrid.streaming import twins

from . import models
from .adapter import ROW, ROWS6, SIG, UNIT, pairs, rows6, sig, table
from .registry import query, r6

E = "e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS x FROM embeddings)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


#: Seconds of a class's series that make a recording; the last one has what is left over as well, so a recording is as long as this and shorter than twice this.
NIGHT = 4 * 3600


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A class's vectors one after another, 64 samples a second, on all channels that generators ask for; a stretch of the
    recording is repeated until it lasts six minutes, the longest window of a generator and more. A series longer than a night is one recording a night, back to back."""
    w = Window.partitionBy("label").orderBy("vec_id")
    names = ["eeg", "eog", "emg", "ecg", "effort_sum", "flow", "airflow_pressure", "effort_thoracic", "effort_abdominal", "eeg_frontal", "eeg_occipital", "spo2", "snore"]
    v = vectors(spark, sf).withColumn("place", F.row_number().over(w))
    v = v.withColumn("n", F.count("*").over(Window.partitionBy("label"))).withColumn("round", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(360) / F.col("n")).cast("int"))))
    v = v.withColumn("chunk_id", (F.col("round") * F.col("n") + F.col("place")).cast("long"))
    total = F.col("n") * (F.ceil(F.lit(360) / F.col("n")) + 1)
    night = F.least(F.floor((F.col("chunk_id") - 1) / NIGHT), F.greatest(F.floor(total / NIGHT) - 1, F.lit(0)))
    v = v.withColumn("start_us", (night * NIGHT * 1_000_000).cast("long"))
    return v.select(F.col("label").cast("long").alias("subject_id"), "start_us", F.explode(F.array(*[F.lit(n) for n in names])).alias("channel"), "chunk_id", F.lit(64.0).alias("fs"), F.lit("uV").alias("units"), "x").withColumn(
        # a beat a second, as far from its middle as the vector's first number says
        "samples", F.when(F.col("channel") == "ecg", F.expr("transform(x, (v, i) -> exp(-pow((i / 64.0 - 0.5 - 0.1 * x[0]) / 0.015, 2) / 2))")).otherwise(F.col("x"))
    ).drop("x")


@query("f5_f8_band_power", f"WITH {E}, s AS (SELECT vec_id, i, x[i + 1] AS v FROM e, range(64) t(i)), f AS (SELECT vec_id, k, sum(v * cos(2 * pi() * k * i / 64)) AS re, sum(v * sin(2 * pi() * k * i / 64)) AS im FROM s, range(33) t(k) GROUP BY 1, 2) SELECT vec_id, round(sum(re * re + im * im) FILTER (k >= 4 AND k < 8), 4) AS theta, round(sum(re * re + im * im) FILTER (k >= 8 AND k < 12), 4) AS alpha FROM f GROUP BY 1")
def band_powers(spark, sf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = np.arange(33)
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            p = np.abs(np.fft.rfft(x)) ** 2
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dsp.band_power(f, p, 4, 8)), pa.array(dsp.band_power(f, p, 8, 12))], names=["vec_id", "theta", "alpha"])

    out = vectors(spark, sf).select("vec_id", "x").mapInArrow(run, "vec_id long, theta double, alpha double")
    return out.select("vec_id", F.round("theta", 4).alias("theta"), F.round("alpha", 4).alias("alpha"))


@query("f40_epoch_ptp_flat", f"WITH {E} SELECT vec_id, round(list_max(x) - list_min(x), 6) AS ptp, list_max(x) = list_min(x) AS flat, round(list_sum(list_transform(x, lambda v: v * v)), 6) AS energy FROM e")
def epoch_ptp(spark, sf):
    v = vectors(spark, sf)
    return v.select("vec_id", r6(F.array_max("x") - F.array_min("x"), "ptp"), (F.array_max("x") == F.array_min("x")).alias("flat"), r6(F.aggregate("x", F.lit(0.0), lambda a, b: a + b * b), "energy"))


@query("f6_loglog_fit", f"WITH {SIG}, p AS (SELECT subject_id, ln(k + 1) AS a, ln(v + 1) AS b FROM sig) SELECT subject_id, round(regr_slope(b, a), 6) AS slope, round(regr_intercept(b, a), 6) AS intercept, round(-regr_slope(b, a), 6) AS exponent FROM p GROUP BY 1 HAVING count(*) >= 5")
def loglog(spark, sf):
    p = sig(spark, sf).select("subject_id", F.ln(F.col("k") + 1).alias("a"), F.ln(F.col("v") + 1).alias("b"))
    g = p.groupBy("subject_id").agg(F.regr_slope("b", "a").alias("s"), F.regr_intercept("b", "a").alias("i"), F.count("*").alias("n")).filter("n >= 5")
    return g.select("subject_id", r6("s", "slope"), r6("i", "intercept"), r6(-F.col("s"), "exponent"))


@query("f7_band_median_mean", f"WITH {SIG} SELECT subject_id, round(median(v) FILTER (k BETWEEN 8 AND 11), 6) AS med, round(avg(v) FILTER (k BETWEEN 11 AND 16), 6) AS mean FROM sig GROUP BY 1")
def band_median(spark, sf):
    s = sig(spark, sf)
    return s.groupBy("subject_id").agg(r6(F.percentile(F.when(F.col("k").between(8, 11), F.col("v")), F.lit(0.5)), "med"), r6(F.avg(F.when(F.col("k").between(11, 16), F.col("v"))), "mean"))


@query("f9_decibels", f"WITH {SIG} SELECT event_id, round(10 * log10(greatest(v, 2.2250738585072014e-308)), 6) AS db FROM sig")
def decibels(spark, sf):
    return sig(spark, sf).select("event_id", r6(10 * F.log10(F.greatest("v", F.lit(2.2250738585072014e-308))), "db"))


@query("f10_frame_rate", f"WITH {SIG}, d AS (SELECT subject_id, t_us - lag(t_us) OVER (PARTITION BY subject_id ORDER BY t_us) AS d FROM sig) SELECT subject_id, round({float(UNIT)} / median(d), 6) AS rate FROM d GROUP BY 1")
def frame_rate(spark, sf):
    d = sig(spark, sf).withColumn("d", F.col("t_us") - F.lag("t_us").over(Window.partitionBy("subject_id").orderBy("t_us")))
    return d.groupBy("subject_id").agg(r6(float(UNIT) / F.percentile("d", F.lit(0.5)), "rate"))


@query("f20_instantaneous_rate", f"WITH {SIG}, d AS (SELECT event_id, subject_id, t_us, 60.0 * {UNIT} / (lead(t_us) OVER w - t_us) AS r FROM sig WINDOW w AS (PARTITION BY subject_id ORDER BY t_us)) SELECT event_id, round(coalesce(r, lag(r) OVER (PARTITION BY subject_id ORDER BY t_us)), 6) AS rate FROM d")
def inst_rate(spark, sf):
    w = Window.partitionBy("subject_id").orderBy("t_us")
    d = sig(spark, sf).withColumn("r", F.try_divide(F.lit(60.0 * UNIT), (F.lead("t_us").over(w) - F.col("t_us")).cast("double")))
    return d.select("event_id", r6(F.coalesce("r", F.lag("r").over(w)), "rate"))


@query("f27_clean_intervals", f"WITH {SIG}, d AS (SELECT event_id, subject_id, t_us, (t_us - lag(t_us) OVER (PARTITION BY subject_id ORDER BY t_us)) / {UNIT}.0 AS rr FROM sig), k AS (SELECT * FROM d WHERE rr IS NOT NULL), m AS (SELECT *, quantile_cont(rr, 0.5) OVER (PARTITION BY subject_id ORDER BY t_us ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS med FROM k) SELECT event_id, rr >= 0.5 AND rr <= 48 AND abs(rr - med) <= 0.9 * med AS clean FROM m")
def clean_intervals(spark, sf):
    w = Window.partitionBy("subject_id").orderBy("t_us")
    d = sig(spark, sf).withColumn("rr", (F.col("t_us") - F.lag("t_us").over(w)) / float(UNIT)).filter("rr IS NOT NULL")
    med = F.percentile("rr", F.lit(0.5)).over(w.rowsBetween(-4, 4))
    return d.withColumn("med", med).select("event_id", ((F.col("rr") >= 0.5) & (F.col("rr") <= 48) & (F.abs(F.col("rr") - F.col("med")) <= 0.9 * F.col("med"))).alias("clean"))


@query("f28_beat_variability", f"WITH {SIG} SELECT event_id, count(*) OVER w AS n, round(CASE WHEN count(*) OVER w > 1 THEN stddev_samp(v) OVER w END, 6) AS sdnn, round(max(v) OVER w - min(v) OVER w, 6) AS range FROM sig WINDOW w AS (PARTITION BY subject_id ORDER BY t_us RANGE BETWEEN {36 * UNIT} PRECEDING AND {36 * UNIT} FOLLOWING)")
def beat_variability(spark, sf):
    w = Window.partitionBy("subject_id").orderBy("t_us").rangeBetween(-36 * UNIT, 36 * UNIT)
    n = F.count("*").over(w)
    return sig(spark, sf).select("event_id", n.alias("n"), r6(F.when(n > 1, F.stddev_samp("v").over(w)), "sdnn"), r6(F.max("v").over(w) - F.min("v").over(w), "range"))


@query("f45_lead_weights", f"WITH {SIG}, b AS (SELECT event_id, v < 10 AS left_bad, k < 10 AS right_bad, v, k FROM sig) SELECT event_id, CASE WHEN left_bad = right_bad THEN 0.5 WHEN left_bad THEN 0.0 ELSE 1.0 END AS left_weight, round(CASE WHEN left_bad = right_bad THEN (v + k) / 2 WHEN left_bad THEN k ELSE v END, 6) AS weighted FROM b")
def lead_weights(spark, sf):
    a, b = F.col("v") < 10, F.col("k") < 10
    w = F.when(a == b, 0.5).when(a, 0.0).otherwise(1.0)
    return sig(spark, sf).select("event_id", w.alias("left_weight"), r6(w * F.col("v") + (1 - w) * F.col("k"), "weighted"))


@query("f48_least_squares_residual", f"WITH {SIG}, r AS (SELECT subject_id, regr_slope(v, k) AS s, regr_intercept(v, k) AS i FROM sig GROUP BY 1) SELECT event_id, round(v - (s * k + i), 6) AS residual FROM sig JOIN r USING (subject_id)")
def residual(spark, sf):
    s = sig(spark, sf)
    r = s.groupBy("subject_id").agg(F.regr_slope("v", "k").alias("s"), F.regr_intercept("v", "k").alias("i"))
    return s.join(r, "subject_id").select("event_id", r6(F.col("v") - (F.col("s") * F.col("k") + F.col("i")), "residual"))


OXY = f"{SIG}, i AS (SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY t_us) - 1 AS i, v - 2 AS v FROM sig)"


def oxygen(spark, sf):
    return sig(spark, sf).select("subject_id", (F.row_number().over(Window.partitionBy("subject_id").orderBy("t_us")) - 1).alias("i"), (F.col("v") - 2).alias("v"))


BAD = OXY + """, y AS (SELECT *, i - row_number() OVER (PARTITION BY subject_id, v <= 0 ORDER BY i) AS g FROM i), br AS (SELECT subject_id, min(i) AS st, count(*) AS n FROM y WHERE v <= 0 GROUP BY subject_id, g), bad AS (SELECT subject_id, greatest(st - 60, 0) AS start, greatest(st - 60, 0) + n + 119 AS "end" FROM br)"""
DROPS = """, d AS (SELECT *, v - lag(v) OVER (PARTITION BY subject_id ORDER BY i) AS d FROM i), s AS (SELECT *, sum(CASE WHEN d > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY i) AS s FROM d), dr AS (SELECT subject_id, max(v) - min(v) AS rng, min(i) FILTER (d < -0.3) AS start, max(i) FILTER (d < -0.3) AS "end" FROM s GROUP BY subject_id, s)"""


@query("f31_spo2_bad_runs", f"WITH {BAD} SELECT * FROM bad")
def spo2_bad(spark, sf):
    return spo2.bad_runs(oxygen(spark, sf))


@query("f32_spo2_segment_drops", f'WITH {OXY}{DROPS} SELECT subject_id, round(rng, 6) AS range, start, "end" FROM dr WHERE rng >= 40 AND start IS NOT NULL')
def spo2_drops(spark, sf):
    return spo2.segment_drops(oxygen(spark, sf), 40).select("subject_id", r6("range"), "start", "end")


JAG = """, fm AS (SELECT *, v - min(v) OVER (PARTITION BY subject_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) > 40 AS c FROM i), je AS (SELECT *, lead(c) OVER (PARTITION BY subject_id ORDER BY i) AS nc FROM fm), jr AS (SELECT subject_id, i FROM je WHERE c AND NOT coalesce(nc, false)),
jg AS (SELECT jr.subject_id, jr.i AS start, arg_min(x.i, (x.v, x.i)) AS "end" FROM jr JOIN i x ON x.subject_id = jr.subject_id AND x.i BETWEEN jr.i AND jr.i + 29 GROUP BY 1, 2)"""


@query("f33_spo2_jagged_drops", f'WITH {OXY}{JAG} SELECT subject_id, start, "end" FROM jg')
def spo2_jagged(spark, sf):
    return spo2.jagged_drops(oxygen(spark, sf), 40)


@query("f34_spo2_depth", f"WITH {OXY} SELECT subject_id, i, round(greatest(v - min(v) OVER (PARTITION BY subject_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING), 0), 6) AS depth FROM i")
def spo2_depth(spark, sf):
    return spo2.with_depth(oxygen(spark, sf)).select("subject_id", "i", r6("depth"))


@query("g14_spo2_clean_drops", f"""WITH {BAD}{DROPS}{JAG}, u AS (SELECT subject_id, start, "end" FROM dr WHERE rng >= 40 AND start IS NOT NULL UNION ALL SELECT subject_id, start, "end" FROM jg), c AS (SELECT DISTINCT subject_id, unnest(range(start, "end" + 1)) AS i FROM u),
g AS (SELECT *, i - row_number() OVER (PARTITION BY subject_id ORDER BY i) AS g FROM c), m AS (SELECT subject_id, min(i) AS start, max(i) AS "end" FROM g GROUP BY subject_id, g) SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.subject_id = m.subject_id AND m.start <= bad."end" AND m."end" >= bad.start)""")
def spo2_clean(spark, sf):
    return spo2.clean_drops(oxygen(spark, sf), 40)


def _register_generator(name: str) -> None:
    @query(f"g_{name}")
    def run(spark, sf):
        # breaths of the vectors, which are scaled to 1, need no least height; their random walks are no recording of beats either
        options = {"cutoff": 0.0} if name == "respiration" else {}
        return generators.run_generator(chunks(spark, sf), name, **options).withColumn("v", F.round("v", 6))


for _name in generators.GENERATORS:
    _register_generator(_name)


EVENT_GENERATORS = ("eeg_arousal_features", "emg_tone_features", "pan_tompkins", "respiration", "spo2_drop", "effort_snore_features", "apnea_events")


@query("g_event_tables")
def event_tables(spark, sf):
    """Events of all generators that have some, with their first and last samples."""
    return generators.run_events(chunks(spark, sf), EVENT_GENERATORS, respiration={"cutoff": 0.0}).select("subject_id", "algo", "event", "kind", "start", "end", "start_us", "end_us")


FLAT = """WITH x AS (SELECT user_id AS subject_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events), lo AS (SELECT *, k <= 20 AS low FROM x), g AS (SELECT subject_id, i, i - row_number() OVER (PARTITION BY subject_id ORDER BY i) AS g FROM lo WHERE low),
r AS (SELECT subject_id, min(i) AS a, max(i) + 1 AS b FROM g GROUP BY subject_id, g), n AS (SELECT subject_id, count(*) AS n FROM x GROUP BY 1), w AS (SELECT subject_id, greatest(a - 60, 0) AS a, least(greatest(a - 60, 0) + (b - a) + 120, n) AS b FROM r JOIN n USING (subject_id)), c AS (SELECT DISTINCT subject_id, unnest(range(a, b)) AS i FROM w),
h AS (SELECT subject_id, i, i - row_number() OVER (PARTITION BY subject_id ORDER BY i) AS g FROM c)"""


def oxygen_nights(spark, sf):
    """Each user's series as an oxygen recording of one second a sample; values up to twenty count as lost."""
    w = Window.partitionBy("subject_id").orderBy("t_us", "event_id")
    x = sig(spark, sf).select("subject_id", (F.row_number().over(w) - 1).alias("i"), F.greatest(F.col("k") - 20, F.lit(0.0)).alias("k"))
    return x.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("i", "k"))).alias("s")).select("subject_id", F.lit("spo2").alias("channel"), F.lit(0).cast("long").alias("chunk_id"), F.lit(1.0).alias("fs"), F.lit("%").alias("units"), F.col("s.k").alias("samples"))


@query("g_flat_stretches", FLAT + ' SELECT subject_id, min(i) AS start, max(i) AS "end" FROM h GROUP BY subject_id, g')
def flat_stretches(spark, sf):
    """Bad oxygen stretches as events."""
    return generators.run_events(oxygen_nights(spark, sf), ("spo2_drop",)).filter("event = 'bad_spo2'").select("subject_id", "start", "end")


@query("tvf_bad_oxygen", FLAT + " SELECT x.subject_id, count(*) AS seconds, count(h.i) AS bad FROM x LEFT JOIN h USING (subject_id, i) GROUP BY 1")
def bad_oxygen(spark, sf):
    """A generator called from SQL as a table function."""
    table_functions.register(spark, names=("spo2_drop",))
    oxygen_nights(spark, sf).createOrReplaceTempView("oxygen_nights")
    return spark.sql("SELECT subject_id, count(*) AS seconds, CAST(sum(v) AS BIGINT) AS bad FROM spo2_drop(TABLE(oxygen_nights) PARTITION BY subject_id) WHERE signal = 'spo2_bad_mask' GROUP BY subject_id")


@query("g20_feature_table")
def feature_table(spark, sf):
    c = chunks(spark, sf)
    return generators.feature_table(generators.run_generators(c, ("one_second_tracks", "slow_wave_features")))


@query("j19_peak_agreement")
def peak_agreement(spark, sf):
    """Peaks of a reference channel absorb the other channels' peaks near them, first come first served: mean position and count."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("t_us")
        pos, chan = np.array(t.column("t_us").to_pylist()), np.array(t.column("stage").to_pylist())
        free = chan != 0
        out = []
        for p in pos[chan == 0]:
            near = np.flatnonzero(free & (np.abs(pos - p) <= 6 * UNIT))
            first = [near[chan[near] == c][0] for c in sorted(set(chan[near].tolist()))]
            free[first] = False
            out.append((int(round(np.mean([p, *pos[first]]))), 1 + len(first)))
        s = t.column("subject_id")[0].as_py() if len(t) else 0
        return pa.table({"subject_id": pa.array([s] * len(out), pa.int64()), "t_us": pa.array([o[0] for o in out], pa.int64()), "channels": pa.array([o[1] for o in out], pa.int32())})

    return sig(spark, sf).select("subject_id", "t_us", "stage").groupBy("subject_id").applyInArrow(run, "subject_id long, t_us long, channels int")


@query("d6_hsmm_viterbi")
def hsmm(spark, sf):
    s = sig(spark, sf)
    trans = decoders.matrix(decoders.change_counts(s, "stage", "t_us", 5), 5)
    emission = decoders.matrix(decoders.emission_counts(pairs(spark, sf), "truth", "pred", 5), 5, "obs")
    learned = decoders.learn_hsmm(runs.runs(s, "stage", "t_us"), "stage").collect()  # one row per state
    rates = np.ones(5)
    for r in learned:
        rates[r["stage"]] = r["rate"]
    d_max = int(round(3 * rates.max()))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("t_us")
        o = np.array(t.column("pred").to_pylist())
        p = emission[:, o].T
        return pa.table({"subject_id": t.column("subject_id"), "t_us": t.column("t_us"), "state": pa.array(decoders.hsmm_viterbi(np.log(p), trans, rates, d_max), pa.int32())})

    return pairs(spark, sf).select("subject_id", "t_us", "pred").groupBy("subject_id").applyInArrow(run, "subject_id long, t_us long, state int")


def model_frame(spark, sf):
    return binning.centred_epochs(rows6(spark, sf), "slot", "stage", ["v", "k"]).withColumn("target", (F.col("stage") >= 2).cast("int"))


EPOCHS = f"""WITH {ROWS6}, bl AS (SELECT subject_id, slot // 5 AS epoch_index, avg(v) AS v, avg(k) AS k FROM rows6 GROUP BY 1, 2 HAVING count(*) = 5), cn AS (SELECT subject_id, slot // 5 AS epoch_index, stage, count(*) AS n FROM rows6 WHERE stage >= 0 GROUP BY 1, 2, 3), lb AS (SELECT subject_id, epoch_index, arg_max(stage, n * 100 - stage) AS stage FROM cn GROUP BY 1, 2), ep AS (SELECT subject_id, epoch_index, v, k, stage FROM bl JOIN lb USING (subject_id, epoch_index))"""


@query("v1_subject_folds", f"""{EPOCHS}, n AS (SELECT subject_id, CASE WHEN stage >= 2 THEN 1 ELSE 0 END AS c, count(*) AS n FROM ep GROUP BY 1, 2),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY c) AS share FROM n), l AS (SELECT subject_id, sum(n) AS size, arg_max(c, share * 2 + c * 1e-12) AS c, md5('7:' || subject_id) AS h FROM s GROUP BY 1),
i AS (SELECT subject_id, (row_number() OVER (ORDER BY c, size DESC, h) - 1) % 10 AS i FROM l) SELECT subject_id, CAST(CASE WHEN i < 5 THEN i ELSE 9 - i END AS INTEGER) AS fold FROM i""")
def folds(spark, sf):
    return models.subject_folds(model_frame(spark, sf), "target")


@query("t2_cross_validated_linear")
def cross_validated(spark, sf):
    p = models.cross_validated(model_frame(spark, sf), ["v", "k"], "target", k=3)
    return p.select("subject_id", "epoch_index", "target", "fold", "y_pred")


@query("t4_permuted_feature")
def permuted(spark, sf):
    return models.permuted(model_frame(spark, sf).select("subject_id", "epoch_index", "v", "k"), "v")


@query("t4_permuted_totals", f"""{EPOCHS} SELECT count(*) AS n, count(DISTINCT (subject_id, epoch_index)) AS epochs, count(v) AS with_v, round(sum(v), 4) AS sum_v, round(sum(v * v), 4) AS sum_v2, round(sum(k), 4) AS sum_k FROM ep""")
def permuted_totals(spark, sf):
    """What a permutation must leave as it is: rows, epochs, and the values of the permuted column and of the others."""
    x = permuted(spark, sf)
    r4 = lambda c, name: F.round(F.sum(c), 4).alias(name)
    return x.agg(F.count("*").alias("n"), F.count_distinct("subject_id", "epoch_index").alias("epochs"), F.count("v").alias("with_v"), r4(F.col("v"), "sum_v"), r4(F.col("v") * F.col("v"), "sum_v2"), r4(F.col("k"), "sum_k"))


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    raw = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select(F.col("user_id").alias("subject_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))


def _drained(df: DataFrame) -> DataFrame:
    """All that a stream has now, as a stored table: a trigger's result is written by the tasks and replaces the one before; nothing comes to the driver. State is kept in
    RocksDB on the executors' disks, its checkpoint in the shared folder."""
    spark = df.sparkSession
    path, provider = new_folder(spark, "stream"), "spark.sql.streaming.stateStore.providerClass"
    spark.createDataFrame([], df.schema).write.parquet(path)  # what a stream without a row has
    known = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        sink = df.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).option("checkpointLocation", new_folder(spark, "stream-state"))
        q = sink.outputMode("complete").trigger(availableNow=True).start()
    finally:
        spark.conf.set(provider, known)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query("stream_tumbling_mean", "SELECT user_id AS subject_id, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) // 1000000 AS start, round(avg(value), 6) AS v, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    return _drained(twins.tumbling_mean(_stream(spark, sf))).select("subject_id", F.unix_seconds("start").alias("start"), r6("v"), "n")


@query("stream_sessions", "WITH g AS (SELECT user_id AS subject_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY subject_id ORDER BY ts) AS s FROM g) SELECT subject_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 43200000000 AS \"end\", count(*) AS n FROM s GROUP BY subject_id, s")
def stream_sessions(spark, sf):
    return _drained(twins.sessions(_stream(spark, sf))).select("subject_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")
