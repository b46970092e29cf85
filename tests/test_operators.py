"""Goldens and invariants of the time-series operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightgrid.functions import dsp, generators, spo2
from nightgrid.operators import asof, binning, decoders, intervals, labels, rolling, runs, stats
from nightgrid.operators.numbering import numbered
from nightgrid.plans import models
from nightgrid.sources import recordings
from nightgrid.streaming import twins

S = 1_000_000


def col(df, order, c):
    return [r[c] for r in df.orderBy(order).collect()]


def signal(spark, values, rate=1.0, subject=1, t0=0.0):
    return spark.createDataFrame([(subject, int(round((t0 + i / rate) * S)), None if v is None else float(v)) for i, v in enumerate(values)], "subject_id long, t_us long, v double")


def test_explicit_times_mean(spark):
    df = spark.createDataFrame([(1, int(t * S), float(v)) for t, v in zip((0.5, 2, 6.5, 13, 13.5), (1, 3, 10, 20, 40))], "subject_id long, t_us long, v double")
    assert col(binning.binned_on_spine(df, 6 * S, S), "row", "v") == [2, 10, 30]


def test_edge_fill_is_bounded(spark):
    df = signal(spark, [1] * 60).withColumn("k", F.lit(0)).unionByName(spark.createDataFrame([(1, 599 * S, None, 0)], "subject_id long, t_us long, v double, k int"))
    v = col(binning.binned_on_spine(df, 6 * S, S), "row", "v")
    assert v[:15] == [1.0] * 15 and v[15:] == [None] * 85


def test_late_first_frame_and_no_drift(spark):
    df = signal(spark, range(400), rate=64 / 19, t0=15)
    v = col(binning.binned_on_spine(df, 6 * S, S), "row", "v")
    assert v[0] == v[1] == v[2]
    t = signal(spark, [1 + i * 26 / 128 for i in range(30000)], rate=128 / 26, t0=1)
    rows = binning.time_bin(t, 6 * S).collect()
    assert all(6 * r["row"] <= r["v"] < 6 * r["row"] + 6 for r in rows)


def test_binary_takes_maximum(spark):
    df = signal(spark, [1 if i == 65 else 0 for i in range(240)], rate=10)
    assert col(binning.binned_on_spine(df, 6 * S, S, reducer="max"), "row", "v") == [0, 1, 0, 0]


def test_nan_and_infinity_are_missing(spark):
    df = signal(spark, [1, float("nan"), float("inf"), 3])
    assert col(binning.time_bin(df, 6 * S), "row", "v") == [2.0]


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([(1, x) for x in (3, 1, 1, 3, 2)], "subject_id long, s int")
    assert binning.windowed_mode(df, "s", ["subject_id"]).collect()[0]["s"] == 1


def test_epochs(spark):
    rows = [(1, i, s, float(i)) for i, s in enumerate([0, 0, 0, 2, 2, 3, 3, 3, -1, -1])]
    e = binning.centred_epochs(spark.createDataFrame(rows, "subject_id long, slot long, stage int, f double"), "slot", "stage", ["f"]).orderBy("epoch_index").collect()
    assert [(r["epoch_index"], r["stage"], r["f"]) for r in e] == [(0, 0, 2.0), (1, 3, 7.0)]


def test_runs_and_bouts(spark):
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate([0, 1, 1, 0, 1])], "subject_id long, i long, m int")
    r = runs.runs(df, "m", "i", only=1).orderBy("start").collect()
    assert [(x["start"], x["length"]) for x in r] == [(1, 2), (4, 1)]
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate([2, 2, 2, 0, 1, 1])], "subject_id long, i long, m int")
    assert [(x["m"], x["length"]) for x in runs.runs(df, "m", "i").orderBy("start").collect()] == [(2, 3), (0, 1), (1, 2)]


@pytest.mark.parametrize("start,hit", [(2, True), (3, False)])
def test_overlap_is_closed(spark, start, hit):
    a = spark.createDataFrame([(1, 7, 0, 2)], "subject_id long, id long, start long, end long")
    b = spark.createDataFrame([(1, start, start)], "subject_id long, start long, end long")
    assert (intervals.overlap_semi(a, b, "id", bucket=2).count() == 1) is hit
    assert (intervals.overlap_anti(a, b, "id", bucket=2).count() == 0) is hit


def test_later_event_paints_over(spark):
    ev = spark.createDataFrame([(1, 10, 12, "APNEA-O", 0), (1, 12, 14, "HYP-C", 1)], "subject_id long, start long, end long, label string, n int")
    n = spark.createDataFrame([(1, 16)], "subject_id long, n long")
    x = ev.withColumn("code", labels.severity(F.col("label")))
    got = {r["row"]: r["code"] for r in intervals.painted(x.withColumnRenamed("n", "ord"), "code", "ord", 1, n).collect()}
    assert got[11] == 2 and got[12] == 1 and got[14] == 1 and got[15] == 0


def test_stage_hold(spark):
    ch = spark.createDataFrame([(1, 60.0, "W"), (1, 120.0, "N1"), (1, 180.0, "N2"), (1, 240.0, "R"), (1, 300.0, "?")], "subject_id long, t_sec double, note string")
    n = spark.createDataFrame([(1, 360.0)], "subject_id long, length double")
    assert col(labels.held_stages(ch, n), "epoch_index", "stage") == [-1, -1, 0, 0, 1, 1, 2, 2, 4, 4, -1, -1]


def test_stage_lines(spark):
    ln = spark.createDataFrame([(1, i, str(c)) for i, c in enumerate([0, 1, 2, 3, 4, 5, 8])], "subject_id long, line_no int, line string")
    s = col(labels.stage_seconds(ln), "second", "stage")
    assert s[::30] == [0, 4, 1, 2, 3, 3, -1] and s[30:60] == [4] * 30


def test_respiratory_lines(spark):
    ln = spark.createDataFrame([(1, 0, "head"), (1, 3, "00:01:00 APNEA-O 12 x"), (1, 4, "00:02:00 HYP-C PB 10"), (1, 5, "00:03:00 POSS - ")], "subject_id long, line_no int, line string")
    r = labels.respiratory_events(ln).orderBy("start").collect()
    assert [(x["start"], x["end"], x["label"]) for x in r] == [(60, 71, "APNEA-O"), (120, 129, "HYP-C")]


def test_spo2_bad_run_at_start(spark):
    df = spark.createDataFrame([(1, i, 0.0 if i == 5 else 95.0) for i in range(300)], "subject_id long, i long, v double")
    r = spo2.bad_runs(df).collect()[0]
    assert (r["start"], r["end"]) == (0, 120)


def test_interpolation(spark):
    s = spark.createDataFrame([(1, 0, 0.0), (1, 10, 10.0)], "subject_id long, t_us long, v double")
    p = spark.createDataFrame([(1, t) for t in (0, 5, 10, 15)], "subject_id long, t_us long")
    assert col(asof.linear(p, s, "t_us", "v"), "t_us", "v") == [0, 5, 10, 10]
    assert col(asof.linear(p, s, "t_us", "v", max_gap=4), "t_us", "v") == [0, None, 10, None]
    assert col(asof.nearest(p, s, "t_us", "v"), "t_us", "v") == [0, 0, 10, None]


def test_sliding_windows(spark):
    df = spark.createDataFrame([(1, i, 1.0 if i == 1 else 0.0) for i in range(12)], "subject_id long, slot long, x double")
    w = rolling.sliding_slots(df, "slot", 11, 1, {"s": F.sum("x")}).orderBy("start_slot").collect()
    assert [r["s"] for r in w] == [1.0, 1.0]


def test_kappa_and_cohens_d(spark):
    one = spark.createDataFrame([(0, 0), (0, 0)], "t int, p int")
    assert stats.summary(one, "t", "p", [0, 1]).collect()[0]["kappa"] == 0.0
    assert stats.summary(one.filter("t = 9"), "t", "p", [0, 1]).collect()[0]["kappa"] is None
    d = spark.createDataFrame([(1.0, True), (1.0, True), (1.0, False), (1.0, False)], "v double, g boolean")
    assert d.agg(stats.cohens_d(F.col("v"), F.col("g")).alias("d")).collect()[0]["d"] == 0.0
    assert d.limit(2).agg(stats.cohens_d(F.col("v"), F.col("g")).alias("d")).collect()[0]["d"] is None


def test_rank_auc_counts_ties_half(spark):
    x = spark.createDataFrame([(1.0, 1, 0), (2.0, 1, 0), (1.0, 0, 0), (0.0, 0, 0)], "v double, y int, g int")
    assert stats.rank_auc(x, "v", "y", ("g",)).collect()[0]["auc"] == 0.875


def test_constant_column_keeps_unit_scale(spark):
    x = spark.createDataFrame([(1, 4.0), (1, 4.0)], "subject_id long, v double")
    for kind in ("standard", "robust", "robust_by_subject"):
        assert col(stats.normalise(x, "v", kind), "v", "v") == [0.0, 0.0]


def test_transitions(spark):
    x = spark.createDataFrame([(1, i, s) for i, s in enumerate([0, 0, 1, 1, 1])], "subject_id long, i long, s int")
    m = decoders.matrix(decoders.transition_counts(x, "s", "i", 2), 2)
    assert np.allclose(m, [[0.5, 0.5], [0.25, 0.75]])
    assert np.allclose(col(decoders.initial_shares(x, "s", "i", 2), "state", "p"), [2 / 3, 1 / 3])


def test_decoders():
    sticky = np.array([[0.95, 0.05], [0.05, 0.95]])
    p = np.tile([0.8, 0.2], (21, 1))
    p[10] = [0.4, 0.6]
    g = decoders.forward_backward(p, sticky, np.array([0.5, 0.5]))
    assert np.allclose(g.sum(1), 1) and g[10].argmax() == 0
    assert decoders.viterbi([0, 0, 1, 0, 0], sticky, np.array([[0.7, 0.3], [0.3, 0.7]])) == [0] * 5
    lp = np.log(np.where(np.arange(20)[:, None] // 10 == np.arange(2), 0.9, 0.1))
    assert decoders.hsmm_viterbi(lp, np.array([[0.5, 0.5], [0.5, 0.5]]), np.array([10.0, 10.0]), 20) == [0] * 10 + [1] * 10


def test_filters_and_spectra():
    fs, t = 128, np.arange(0, 30, 1 / 128)
    inside, outside = (dsp.bandpass(np.sin(2 * np.pi * f * t), fs, 8, 12) for f in (10, 2))
    assert abs(np.std(inside) * np.sqrt(2) - 1) < 0.01 and np.std(outside) < 0.01
    with pytest.raises(ValueError):
        dsp.bandpass(t, fs, 50, 20)
    assert np.array_equal(dsp.bandpass(t, fs, 50, 20, safe=True), t)
    f, p = dsp.welch(2 * np.sin(2 * np.pi * 6 * t), fs, 512)
    assert abs(dsp.band_power(f, p, 4, 8) * f[1] - 2) < 0.01


def test_epoch_ratios_and_gain():
    fs, t = 128, np.arange(0, 120, 1 / 128)
    eeg = 2 * np.sin(2 * np.pi * 6 * t) + np.sin(2 * np.pi * 13 * t) + 0.5 * np.sin(2 * np.pi * 20 * t) + 0.25 * np.sin(2 * np.pi * 40 * t)
    ch = lambda g: {"eeg": (g * eeg, fs), "eog": (g * eeg, fs), "emg": (g * eeg, fs)}
    a, b = (generators.epoch_ratio_features(ch(g)) for g in (1, 1e-3))
    for k, want in {"rel_theta": 4 / 5.25, "rel_sigma": 1 / 5.25, "rel_beta": 0.25 / 5.25, "spindle_rel": 1 / 4.25, "muscle_frac_db": 10 * np.log10(0.0625 / 5.25)}.items():
        assert np.allclose(a[k][0], want, rtol=1e-3), k
        assert np.allclose(a[k][0], b[k][0], rtol=1e-6)
    assert len(a["rel_theta"][0]) == 20


def test_beats_and_variability():
    r = np.random.default_rng(0)
    rr = 1000 + r.normal(0, 15, 1000)
    rr[100], rr[200:202], rr[300] = 2000, (420, 580), 250
    assert list(np.flatnonzero(~dsp.clean_beats(rr))) == [100, 200, 201, 300]
    white, brown = r.normal(size=4000), np.cumsum(r.normal(size=4000))
    assert abs(dsp.dfa(white) - 0.5) < 0.12 and abs(dsp.dfa(brown) - 1.5) < 0.15 and np.isnan(dsp.dfa(white[:100]))
    fs, at = 128, np.arange(0.5, 59, 0.9137)
    t = np.arange(60 * fs) / fs
    x = sum(np.exp(-((t - b) ** 2) / (2 * 0.01**2)) for b in at)
    p = dsp.refine_peaks(x, dsp.r_peaks(x, fs), fs)
    assert len(p) == len(at) and np.abs(p - at).max() < 1.5e-3


def test_slow_waves():
    fs, t = 128, np.arange(0, 60, 1 / 128)
    cover = lambda amp, f: dsp.slow_wave_mask(amp * np.sin(2 * np.pi * f * t), fs).mean()
    assert cover(50, 1) > 0.8 and cover(25, 1) == 0 and cover(50, 6) < 0.05


def test_breaths_regular_and_not():
    fs, t = 8, np.arange(0, 600, 1 / 8)
    reg = generators.breath_regularity({"effort": (np.sin(2 * np.pi * 0.25 * t), fs)})
    assert np.nanmedian(reg["breath_interval_cv_60s"][0]) < 0.05 and np.nanmedian(reg["breath_amp_cv_60s"][0]) < 0.05
    amp = np.repeat(np.random.default_rng(1).uniform(0.3, 2, 151), 32)[: len(t)]
    irr = generators.breath_regularity({"effort": (amp * np.sin(2 * np.pi * 0.25 * t), fs)})
    assert np.nanmedian(irr["breath_amp_cv_60s"][0]) > 0.2


def test_flat_dropout():
    fs, n = 10, 1200
    r = np.random.default_rng(2)
    a, b = r.normal(size=n), r.normal(size=n)
    one = {"x": (a, fs), "y": (b.copy(), fs)}
    a[300:600] = 0
    assert generators.signal_quality(one)["flat_dropout"][0].tolist() == [0] * 20
    b[300:600] = 0
    assert generators.signal_quality({"x": (a, fs), "y": (b, fs)})["flat_dropout"][0].tolist() == [0] * 5 + [1] * 5 + [0] * 10


def test_flat_dropout_thresholds_and_tails():
    flags = lambda ch: generators.signal_quality(ch)["flat_dropout"][0][::5].tolist()
    x = np.random.default_rng(3).normal(size=600)
    half = x.copy()
    half[:150], half[300:440] = 0, 0
    assert flags({"x": (half, 10)}) == [1, 0] and flags({"x": (1e-9 * x, 10)}) == [0, 0]
    assert flags({"x": (np.zeros(300), 10), "y": (np.zeros(600), 10)}) == [1, 0]


def test_emg_floor_and_incomplete_tail():
    fs, r = 64, np.random.default_rng(5)
    tone = np.sin(2 * np.pi * 20 * np.arange(20 * 30 * fs) / fs) * np.repeat([1, 4], 10 * 30 * fs)
    flat = {"eeg": (r.normal(size=600 * fs), fs), "eog": (r.normal(size=600 * fs), fs)}
    got = generators.epoch_ratio_features(flat | {"emg": (tone, fs)})["emg_floor_db"][0][::5]
    assert np.allclose(got[:10], 0, atol=0.1) and np.allclose(got[11:], 10 * np.log10(4), atol=0.1)
    x = r.normal(size=132 * fs)
    t = generators.epoch_ratio_features({"eeg": (x, fs), "eog": (x, fs), "emg": (x, fs)})
    assert all(len(v) == 25 and np.isfinite(v[:20]).all() and np.isnan(v[20:]).all() for v, *_ in t.values())


def test_frame_centres():
    fs, r = 64, np.random.default_rng(6)
    ch = {"eeg": (r.normal(size=120 * fs), fs), "eog": (r.normal(size=120 * fs), fs)}
    assert generators.spindle_features(ch)["splindex"][2] == 1.0 and generators.eeg_arousal_features(ch)["eeg_arousal_signal"][2] == 1.0
    fast, epoch = (generators.eog_rem_features(ch)[k] for k in ("rem_band_power_fast", "rem_power_epoch"))
    bins = round(30 * fast[1])
    assert fast[2] == 15.0 and np.isclose(epoch[2], 15 + 0.5 * (bins - 1) / fast[1]) and np.isclose(epoch[1], fast[1] / bins)


def _rhythm(seconds=1200):
    t = [0.0]
    while t[-1] < seconds:
        t.append(t[-1] + (1000 + 50 * np.sin(2 * np.pi * 0.25 * t[-1])) / 1000)
    return np.array(t)


def test_variability_of_a_known_rhythm():
    def tracks(t):
        rr = np.diff(t) * 1000
        return generators.hrv_tracks(t[1:], rr, dsp.clean_beats(rr), 1200.0)

    t = _rhythm()
    a = tracks(t)
    mid = lambda k, x=a: x[k][300:900]
    assert np.allclose(np.nanmedian(mid("sdnn_150s")), 50 / np.sqrt(2), rtol=0.05) and abs(np.nanmedian(mid("hr_bpm_30s")) - 60) < 1.5
    assert np.nanmax(mid("ln_lf_hf_300s")) < -3 and np.nanmax(mid("hr_slow_sd_300s")) < 0.5 and np.isfinite(mid("dfa_a2_300s")).all()
    odd = np.sort(np.concatenate([np.delete(t, [400, 700]), [500.3, 800.4]]))
    assert abs(np.nanmedian(mid("sdnn_150s")) - np.nanmedian(mid("sdnn_150s", tracks(odd)))) < 5
    walk = np.cumsum(0.8 + 0.2 * np.random.default_rng(1).random(1300))
    assert np.isnan(generators.hrv_tracks(walk[1:5], np.diff(walk[:5]) * 1000, np.ones(4, bool), 60.0)["hr_bpm_30s"]).all()


def test_coupling():
    t, fs = _rhythm(), 8
    at = np.arange(1200 * fs) / fs
    rr = np.diff(t) * 1000
    ok = dsp.clean_beats(rr)
    with_ = generators.coupling(t[1:], rr, ok, np.sin(2 * np.pi * 0.25 * at), fs, 1200.0)
    noise = rr.mean() + np.random.default_rng(2).normal(0, 20, len(rr))
    without = generators.coupling(t[1:], noise, ok, np.sin(2 * np.pi * 0.25 * at), fs, 1200.0)
    assert len(with_) == 1200 and np.nanmedian(with_) > 0.9 and np.nanmedian(without) < 0.5


def test_one_second_tracks_of_an_alpha_night():
    fs, r = 200, np.random.default_rng(7)
    t = np.arange(60 * fs) / fs
    lead = lambda: r.normal(0, 1, len(t)) + 20 * np.sin(2 * np.pi * 10 * t)
    ecg = sum(np.exp(-((t - b) ** 2) / (2 * 0.01**2)) for b in np.arange(0.5, 60))
    ch = {"eeg": (np.stack([lead(), lead()], 1), fs), "eeg_frontal": (lead(), fs), "eeg_occipital": (lead(), fs), "eog": (lead(), fs), "emg": (lead(), fs), "ecg": (ecg, fs), "effort_sum": (np.sin(2 * np.pi * 0.25 * t), fs)}
    out = generators.one_second_tracks(ch)
    assert set(out) == {"c_rel_delta", "c_rel_theta", "c_rel_alpha", "c_rel_sigma", "c_rel_beta", "c_log_power", "f_rel_delta", "o_rel_alpha", "eog_low", "eog_high", "emg_log_rms", "hr", "resp_effort", "resp_env"}
    assert (out["c_rel_alpha"][0][2:-2] > 0.8).all() and np.allclose(np.nan_to_num(out["hr"][0][2:-2], nan=60), 60, atol=0.5)
    few = generators.one_second_tracks({k: ch[k] for k in ("eeg", "eog")})
    assert all(np.allclose(few[k][0], out[k][0], rtol=1e-5) for k in few)


def test_oxygen_drops_of_both_kinds():
    x = np.full(600, 96.0)
    x[100:110], x[110:130] = np.linspace(96, 91, 10), 91
    x[300:330] = 96 - 0.2 * np.arange(30)  # slow: every step is under .3
    x[330:360] = 90.2
    m = generators.oxygen_masks(x, 1.0)
    assert m["drop3"][104] and m["drop4"][104] and m["drop3"][315:330].any() and not m["bad"].any()
    x[5] = 0
    assert dsp.runs(generators.oxygen_masks(x, 1.0)["bad"])[1].tolist() == [121] and not generators.oxygen_masks(x, 1.0)["drop3"][100:115].any()


def test_apneas_need_a_drop_of_oxygen():
    fs, seconds = 8, 900
    t = np.arange(seconds * fs) / fs
    amp = np.where((t >= 300) & (t < 320), 2.0, np.where((t >= 600) & (t < 620), 2.0, 40.0))
    flow = amp * np.sin(2 * np.pi * 0.25 * t)
    events = lambda ch: [(a / fs, b / fs) for a, b in zip(*dsp.runs(generators.apnea_events(ch)["apnea_event_vector"][0] == 2))]
    both = events({"flow": (flow, fs)})
    assert len(both) == 2 and all(abs(a - want) < 8 and 10 < b - a < 30 for (a, b), want in zip(both, (300, 600)))
    spo2_ = np.full(seconds, 96.0)
    spo2_[325:335], spo2_[335:350] = np.linspace(96, 90, 10), 90
    one = events({"flow": (flow, fs), "spo2": (spo2_, 1.0)})
    assert one == both[:1]
    assert not generators.apnea_events({"flow": (flow, fs)})["poor_thermal_airflow_mask"][0].any()


def test_breaths_agreed_by_channels():
    fs = 8
    t = np.arange(300 * fs) / fs
    x = 30 * np.sin(2 * np.pi * 0.25 * t)
    out = generators.respiration({"flow": (x, fs), "airflow_pressure": (0.5 * x, fs), "airflow_thermal": (np.random.default_rng(1).normal(size=len(t)), fs)})
    assert abs(np.nanmedian(out["respiration_rate_bpm"][0]) - 15) < 0.3 and np.allclose(out["respiration_filtered"][0][400:-400], x[400:-400], atol=1.5)
    p, n = generators.agreed_peaks([np.array([10, 50]), np.array([12, 80])], [np.array([4.0, 4.0]), np.array([4.0, 4.0])])
    assert p.tolist() == [11, 50, 80] and n.tolist() == [2, 1, 1]


def test_belts_in_and_out_of_phase():
    fs = 10
    t = np.arange(120 * fs) / fs
    a = np.sin(2 * np.pi * 0.25 * t)
    got = lambda b, f=fs: np.nanmedian(generators.paradoxical_breathing({"effort_thoracic": (a, fs), "effort_abdominal": (b, f)})["thor_abd_corr"][0][400:])
    assert got(a) > 0.99 and got(-a) < -0.99


def test_fast_kernels_on_a_night():
    import time

    n = 8 * 3600 * 200
    x = np.sin(2 * np.pi * 0.25 * np.arange(n) / 200) + 0.1 * np.random.default_rng(0).normal(size=n)
    began = time.perf_counter()
    y = dsp.bandpass(x, 200, 0.1, 0.5)
    middle = time.perf_counter()
    p = dsp.spaced_peaks(y, 300, 0.3)
    assert abs(len(p) - 7200) < 5 and middle - began < 10 and time.perf_counter() - middle < 10
    z = np.cumsum(np.random.default_rng(1).normal(size=1000))
    k = dsp.local_peaks(z)
    plain = [z[i] - max(z[(np.flatnonzero(z[:i] > z[i])[-1:] + 1).tolist()[0] if (z[:i] > z[i]).any() else 0 : i + 1].min(), z[i : i + 1 + (np.flatnonzero(z[i + 1 :] > z[i])[0] if (z[i + 1 :] > z[i]).any() else len(z))].min()) for i in k]
    assert np.allclose(dsp.prominences(z, k), plain)


def test_lanes_units_and_pipelines(spark):
    r = np.random.default_rng(8)
    rows = [(1, c, lane, k, 64.0, "uV", r.normal(0, 20, 64 * 30).tolist()) for c in ("eeg", "eog", "emg", "ecg", "eeg_frontal", "eeg_occipital", "effort_sum") for lane in range(2 if c == "eeg" else 1) for k in range(3)]
    df = spark.createDataFrame(rows, "subject_id long, channel string, lane int, chunk_id int, fs double, units string, samples array<double>")
    tracks, tables = generators.run_pipeline(df, "calibrated")
    seen = {r["algo"] for r in tracks.select("algo").distinct().collect()}
    assert seen == set(generators.PIPELINES["calibrated"]) and tables["6s"].count() == 15
    other = generators.run_generator(df.withColumn("units", F.lit("V")), "topography_features")
    assert other.count() == 0


def test_heart_breath_and_oxygen_without_an_eeg():
    fs, seconds = 200, 600
    t = np.arange(fs * seconds) / fs
    ecg = np.zeros(len(t))
    for k in np.arange(0.5, seconds - 0.5, 0.8):
        i = int(round(k * fs))
        ecg[i - 4 : i + 5] += np.hanning(9)
    belt = np.sin(2 * np.pi * 0.25 * t)
    oxygen = np.full(seconds, 96.0)
    oxygen[100:110], oxygen[300:330] = 90.0, 20.0
    got = {k: v for k, (v, _, _, _) in generators.no_eeg_summaries({"ecg": (ecg, fs), "effort_thoracic": (belt, fs), "effort_abdominal": (-0.5 * belt, fs), "spo2": (oxygen, 1.0)}).items()}
    epochs = [k for k in got if not k.startswith("sec_") and k != "ihr4"]
    assert len(epochs) == 25 and all(len(got[k]) == 20 for k in epochs) and sum(k.startswith("sec_") for k in got) == 7 and len(got["ihr4"]) == 4 * seconds
    mid = slice(3, 17)
    for name, want, within in (("hr_mean", 75, 0.5), ("br_rate", 15, 0.2), ("resp_peak_hz", 0.25, 0.01), ("abd_chest_corr", -1, 1e-6), ("br_interval_cv", 0, 0.02), ("br_count", 7.5, 0.6), ("pnn50", 0, 0), ("br_amp_log", 0, 0.01)):
        assert np.abs(got[name][mid] - want).max() <= within, name
    assert np.isnan(got["ln_lf"][[0, 1, 18, 19]]).all() and np.isnan(got["resp_peak_hz"][[0, 1, 18, 19]]).all() and np.isfinite(got["lf_hf"][mid]).all()
    assert got["spo2_min"][3] == 90 and abs(got["spo2_drop"][3] - 4) < 1e-9 and np.isnan(got["spo2_mean"][10]) and np.nanmax(got["spo2_sd"]) == got["spo2_sd"][3]
    assert generators.no_eeg_summaries({c: (np.zeros(0), 10) for c in ("ecg", "effort_thoracic", "effort_abdominal", "spo2")}) == {}
    silent = generators.no_eeg_summaries({"ecg": (np.zeros(100 * 40), 100), "effort_thoracic": (np.zeros(400), 10), "effort_abdominal": (np.zeros(1000), 25), "spo2": (np.zeros(40), 1)})
    assert np.isnan(silent["hr_mean"][0]).all() and silent["br_count"][0].tolist() == [0] and np.isnan(silent["ecg_noise"][0]).all() and np.isnan(silent["abd_chest_corr"][0]).all()


def test_sparse_closing():
    m = np.zeros(20, bool)
    m[[5, 9]] = True
    out = dsp.sparse_closing(m, 4)
    assert out[5] and out[9] and not out[6]


def test_edf_round_trip(spark, tmp_path):
    t = np.arange(0, 10, 1 / 64)
    eeg, spo2_ = 80 * np.sin(t), np.linspace(90, 98, 10)
    (tmp_path / "ucddb002.rec").write_bytes(recordings.write_edf([("C3-A2", 64, eeg), ("SpO2", 1, spo2_)]))
    rows = {r["channel"]: r for r in recordings.read_edf(spark, f"file://{tmp_path}").collect()}
    assert set(rows) == {"eeg", "spo2"} and rows["eeg"]["fs"] == 64 and rows["eeg"]["subject_id"] == "ucddb002"
    assert np.abs(np.array(rows["eeg"]["samples"]) - eeg).max() < 0.01 and np.abs(np.array(rows["spo2"]["samples"]) - spo2_).max() < 0.01
    assert recordings.discover(spark, f"file://{tmp_path}", "*.rec").collect()[0]["subject_id"] == "ucddb002"


def test_wfdb_round_trip(spark, tmp_path):
    raw = np.stack([np.arange(100), 2 * np.arange(100)], 1).astype("<i2")
    (tmp_path / "tr01.hea").write_text("tr01 2 200 100\ntr01.mat 16+24 10(0)/uV 16 0 0 0 0 C3-M2\ntr01.mat 16+24 5(10)/uV 16 0 0 0 0 ABD\n")
    (tmp_path / "tr01.mat").write_bytes(b"\0" * 24 + raw.tobytes())
    rows = {r["channel"]: r for r in recordings.read_wfdb(spark, f"file://{tmp_path}").collect()}
    assert rows["eeg"]["samples"][10] == 1.0 and rows["effort_abdominal"]["samples"][10] == 2.0
    assert recordings.record_length(spark, f"file://{tmp_path}").collect()[0]["seconds"] == 0.5


def test_derived_channels_truncate(spark):
    c = spark.createDataFrame([("a", "eog_left", 0, 1.0, "uV", [3.0, 4.0, 5.0]), ("a", "eog_right", 0, 1.0, "uV", [1.0, 1.0])], recordings.SCHEMA)
    assert recordings.derived_channels(c).filter("channel = 'eog'").collect()[0]["samples"] == [2.0, 3.0]


def test_belts_are_summed_once_and_reach_the_generators(spark):
    rows = [(s, c, 0, 1.0, "uV", [v]) for s in ("a", "b") for c, v in (("effort_thoracic", 1.0), ("effort_abdominal", 2.0))] + [("b", "effort_sum", 0, 1.0, "uV", [7.0])]
    out = recordings.derived_channels(spark.createDataFrame(rows, recordings.SCHEMA)).filter("channel = 'effort_sum'").collect()
    assert sorted((r["subject_id"], r["samples"]) for r in out) == [("a", [3.0]), ("b", [7.0])]
    known = {c for _, _, f in generators.GENERATORS.values() for c in f.channels}
    assert {recordings.canonical(n) for n in ("CHEST", "ABD", "ribcage", "abdo", "Sum", "SaO2", "Flow", "ECG", "C3-M2", "E1-M2", "Chin1-Chin2")} <= known


def test_folds_keep_subjects_apart(spark):
    rows = [(s, i, float(i % 7 + s), (i + s) % 2) for s in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "subject_id long, i long, f double, y int")
    folds = models.subject_folds(df, "y", 3)
    assert folds.count() == 6 and folds.join(models.subject_folds(df.repartition(7), "y", 3), ["subject_id", "fold"]).count() == 6  # however the rows lie
    assert [r["n"] for r in folds.groupBy("fold").agg(F.count("*").alias("n")).collect()] == [2, 2, 2]
    p = models.cross_validated(df, ["f"], "y", k=3)
    assert p.count() == 240 and p.groupBy("subject_id").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).collect()[0][0] == 1


def test_permutation_keeps_values(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(200)], "i long, v double")
    p = models.permuted(df, "v")
    assert sorted(col(p, "i", "v")) == [float(i) for i in range(200)] and col(p, "i", "v") != [float(i) for i in range(200)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_permutation_of_a_large_table_keeps_every_row(spark, tmp_path, adaptive):
    """Stored rows over many partitions: each id once, the same values, and the other columns as they were."""
    n = 2_000_000
    spark.range(0, n, 1, 64).select("id", (F.col("id") % 1000).alias("g"), (F.col("id") * 3 % 700_001).cast("double").alias("v")).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.read.parquet(str(tmp_path / "t"))
        p = models.permuted(df, "v")
        got = p.agg(F.count("*"), F.count_distinct("id"), F.sum("v"), F.sum((F.col("g") == F.col("id") % 1000).cast("int")), F.sum((F.col("v") == F.col("id") * 3 % 700_001).cast("int"))).first()
        assert got[:4] == (n, n, df.agg(F.sum("v")).first()[0], n) and got[4] < n / 100
        counts = p.groupBy("v").count().join(df.groupBy("v").agg(F.count("*").alias("want")), "v", "full")
        assert counts.filter("NOT count <=> want").isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(i * 37 % 101, f"x{i}") for i in range(101)] + [(5, "tie")], "k long, s string").repartition(9)
    rows = numbered(df, F.col("k").desc(), "s", name="i").orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(102)) and [r["k"] for r in rows] == sorted((r["k"] for r in rows), reverse=True)
    assert numbered(df.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        numbered(df, "k", name="s")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, i * 10 * S, float(10 if i not in (5, 6) else 2)) for i in range(12)]
    df = spark.createDataFrame(rows, "subject_id long, t_us long, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = twins.peak_baseline(src, 120 * S).writeStream.format("memory").queryName("peaks").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("peaks").orderBy("t_us").collect()
    base, drop = dsp.adaptive_baseline(np.array([r[1] for r in rows]) / S, np.array([r[2] for r in rows]))
    assert [r["is_drop"] for r in got] == drop.tolist() and np.allclose([r["baseline"] for r in got], base)
