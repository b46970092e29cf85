"""Event tables of the generators."""

import numpy as np
from pyspark.sql import functions as F

from nightgrid.functions import dsp, generators
from nightgrid.sources import recordings

R = np.random.default_rng(9)


def night(fs=32, seconds=420):
    t = np.arange(fs * seconds) / fs
    breath = 40 * np.sin(2 * np.pi * 0.25 * t)
    breath[fs * 200 : fs * 230] *= 0.02  # a pause
    oxygen = np.full(seconds, 97.0)
    oxygen[225:245] = 90
    oxygen[400:404] = 0
    emg = R.normal(0, 20, fs * 4 * seconds)
    emg[fs * 4 * 300 : fs * 4 * 320] *= 0.05
    ecg = sum(np.exp(-((np.arange(128 * seconds) / 128 - b) ** 2) / (2 * 0.012**2)) for b in np.arange(0.5, seconds, 0.9))
    eeg = R.normal(0, 5, 100 * seconds)
    return {"flow": (breath, fs), "airflow_pressure": (breath, fs), "spo2": (oxygen, 1), "emg": (emg, fs * 4), "ecg": (ecg, 128), "eeg": (eeg, 100)}


def frame(spark, channels, subject="a"):
    rows = [(subject, c, k, float(fs), "uV", x[i : i + 300 * fs].tolist()) for c, (x, fs) in channels.items() for k, i in enumerate(range(0, len(x), 300 * fs))]
    return spark.createDataFrame(rows, recordings.SCHEMA)


def test_events_are_the_runs_of_their_masks(spark):
    ch = night()
    names = ("eeg_arousal_features", "emg_tone_features", "pan_tompkins", "spo2_drop", "apnea_events", "respiration")
    df = frame(spark, ch).unionByName(frame(spark, {"emg": ch["emg"]}, "b"))
    events = generators.run_events(df, names).collect()
    tracks = generators.run_generators(df.filter("subject_id = 'a'"), names)
    for (algo, mask), event in {("emg_tone_features", "emg_suppression_mask"): "emg_suppression", ("spo2_drop", "spo2_bad_mask"): "bad_spo2", ("spo2_drop", "spo2_drop3_mask"): "spo2_drop_3", ("apnea_events", "poor_thermal_airflow_mask"): "poor_thermal_airflow", ("eeg_arousal_features", "eeg_arousal_mask"): "eeg_arousal"}.items():
        x = tracks.filter((F.col("algo") == algo) & (F.col("signal") == mask)).orderBy("idx").collect()
        a, b = dsp.runs(np.array([r["v"] for r in x]) > 0.5)
        got = sorted((r["start"], r["end"], r["start_us"], r["end_us"]) for r in events if r["event"] == event and r["subject_id"] == "a")
        assert got == [(s, e - 1, x[s]["t_us"], x[e - 1]["t_us"]) for s, e in zip(a.tolist(), b.tolist())]
    assert not any(r["signal"].startswith(generators.EVENT) for r in tracks.select("signal").distinct().collect())
    assert {r["algo"] for r in events if r["subject_id"] == "b"} == {"emg_tone_features"}  # the others lack their channels


def test_a_pause_with_a_drop_is_an_apnea(spark):
    events = generators.run_events(frame(spark, night()), ("apnea_events",)).collect()
    apneas = [(r["start"] / r["rate"], r["end"] / r["rate"]) for r in events if r["event"] == "apnea"]
    assert len(apneas) == 1 and 195 < apneas[0][0] < 206 and 224 < apneas[0][1] < 236 and {r["kind"] for r in events} == {"period"}


def test_points(spark):
    events = generators.run_events(frame(spark, night()), ("pan_tompkins", "respiration")).collect()
    beats = sorted(r["start"] for r in events if r["event"] == "r_peak")
    assert len(beats) > 440 and all(r["start"] == r["end"] and r["kind"] == "point" for r in events)
    gaps = np.diff(sorted(r["start_us"] for r in events if r["event"] == "breath_peak"))
    assert abs(np.median(gaps) - 4e6) < 1e5 and sum(r["event"] == "breath_trough" for r in events) > 80


def test_no_rows(spark):
    assert generators.run_events(frame(spark, night()).limit(0), ("spo2_drop",)).collect() == []
