"""Selectors, quality rules, builders and experiment loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightgrid.functions import generators
from nightgrid.operators import markers, quality, selectors
from nightgrid.plans import experiments, reference
from nightgrid.sources import recordings


def test_selectors(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2, 0.3, 1, "x")], "subject_id long, spindle_features__splindex double, spindle_features__mask double, topography_features__a double, label__stage_30s int, s string")
    assert selectors.spec_columns(df, "staging_core") == ["spindle_features__splindex"]
    assert selectors.numeric_features(df) == ["spindle_features__splindex", "spindle_features__mask", "topography_features__a"]
    assert selectors.usable_signal("a", "uV") and not selectors.usable_signal("a_mask", "uV") and not selectors.usable_signal("a", "class")
    assert selectors.norm_of("spindle_features__x", {"spindle": "none", "spindle_features__x": "standard"}) == "standard" and selectors.norm_of("q", {}, {"q": "robust"}) == "robust" and selectors.norm_of("q", {}) == "robust_by_subject"
    assert not selectors.normalisable("epoch_ratio_features__a") and selectors.family("a__b") == "a"
    assert selectors.without(["a1", "b1", "a2"], ("a*",)) == ["b1"]
    assert selectors.stream_needed("x_algo", ("^_algo",)) and selectors.stream_needed("x", ("x*",)) and not selectors.stream_needed("y", ("x*",))


def test_quality_rules(spark):
    df = spark.createDataFrame([(0.6, 0.0, 1.0, 0.0), (0.0, 0.95, 1.0, 0.0), (0.0, 0.0, 900.0, 0.0), (0.0, 0.0, 1.0, 0.5), (0.0, 0.0, 1.0, 0.0)], "l double, e double, p double, f double")
    assert [r[0] for r in df.select(quality.bad_second("l", "e", "p", "f")).collect()] == [True, True, True, True, False]
    assert [r[0] for r in df.select(quality.bad_second("l", "e", "p", "f", emg=True)).collect()] == [False, False, False, True, False]
    w = spark.createDataFrame([(True, True), (False, False), (True, False), (False, True)], "a boolean, b boolean")
    assert [r[0] for r in w.select(quality.lead_weight("a", "b")).collect()] == [0.5, 0.5, 0.0, 1.0]


def test_row_median_skips_missing(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (float("nan"), None, None)], "a double, b double, c double")
    assert [r["median"] for r in quality.row_median(df, ["a", "b", "c"]).collect()] == [2.0, None]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(s, i, float(i % 2) + 0.01 * s, float((i * 7) % 5), i % 2) for s in range(6) for i in range(30)]
    return spark.createDataFrame(rows, "subject_id long, i long, good double, noise double, y int").cache()


def test_ranking_and_stage_fit(frame):
    top = experiments.auc_ranking(frame, ["good", "noise"], "y", [0, 1]).filter("rank = 1").collect()
    assert {r["feature"] for r in top} == {"good"} and all(r["separation"] == 1.0 for r in top)
    assert experiments.stage_fit(frame, ["good", "noise"], "y", 1) > 0.99


def test_drop_column_and_selection(frame):
    d = dict(experiments.drop_column(frame, ["good", "noise"], "y", [0, 1], k=2))
    assert d["good"] < -0.2 and abs(d["noise"]) < 0.05
    assert experiments.greedy_selection(frame, ["good", "noise"], "y", [0, 1], most=1, k=2)[0][0] == "good"


def test_vote_takes_first_of_equals(spark):
    df = spark.createDataFrame([(0.2, 0.7, 0.1), (0.5, 0.5, 0.0), (0.0, 0.0, 0.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(experiments.vote(["a", "b", "c"])).collect()] == [1, 0, 0]


def test_second_stage_context_names(spark):
    df = spark.createDataFrame([(1, i, [0.9, 0.1], 0) for i in range(5)], "subject_id long, i long, proba array<double>, y int")
    x, names = experiments.probability_context(df, "i", 2, 1)
    r = x.filter("i = 0").collect()[0]
    assert len(names) == 2 * 2 * 3 + 3 and r["p0_0"] is None and r["p0_1"] == 0.9 and abs(r["margin"] - 0.8) < 1e-9


def test_holdout_is_scored_once(spark, tmp_path):
    led = experiments.Ledger(spark, str(tmp_path / "looks"))
    pred = spark.createDataFrame([(9, 1, 1), (9, 0, 1)], "subject_id long, y int, y_pred int")
    dev = spark.createDataFrame([(1,)], "subject_id long")
    led.score_once("h", pred, "y", [0, 1], dev)
    with pytest.raises(PermissionError):
        led.score_once("h", pred, "y", [0, 1], dev)
    with pytest.raises(ValueError):
        led.score_once("g", pred.withColumn("subject_id", F.lit(1).cast("long")), "y", [0, 1], dev)


def test_markers_of_a_made_night(spark):
    r = np.random.default_rng(3)
    n = 600
    t = {c: r.normal(0, 1, n) for c in markers.TRACKS}
    t["f_rel_delta"][:300] -= 5  # low delta, where bursts of the eyes count
    t["eog_high"][[5, 7, 35, 400]] = 50.0
    t["eog_low"] = 3 + 2 * t["f_rel_delta"] - t["c_log_power"]
    t["eog_low"][300:330] += 4
    t["o_rel_alpha"] = np.full(n, 2.0)
    t["o_rel_alpha"][90:120] = 1.0
    t["emg_log_rms"][500:530] = np.nan
    rows = [(7, i, *[float(t[c][i]) for c in markers.TRACKS]) for i in range(n)]
    df = spark.createDataFrame(rows, "subject_id long, second long, " + ", ".join(f"{c} double" for c in markers.TRACKS))
    got = {x["epoch_index"]: x for x in markers.epoch_markers(df).collect()}
    high = lambda c: t[c] > np.nanmedian(t[c]) + 2 * 1.4826 * np.nanmedian(np.abs(t[c] - np.nanmedian(t[c])))
    near = [t["c_log_power"][max(0, i - 15) : i + 16] for i in range(n)]
    jump = np.array([x > np.median(w) + 2.5 * 1.4826 * np.median(np.abs(w - np.median(w))) for x, w in zip(t["c_log_power"], near)])
    low = lambda c: t[c] < np.nanmedian(t[c])
    plain = {"rem_eye_bursts": high("eog_high") & low("f_rel_delta"), "kcomplex_events": jump & (t["c_rel_delta"] > np.median(t["c_rel_delta"])), "sawtooth_theta": high("c_rel_theta") & low("emg_log_rms")}
    assert len(got) == 20 and all([got[k][m] for k in range(20)] == v.reshape(20, 30).sum(1).tolist() for m, v in plain.items()) and plain["rem_eye_bursts"][[5, 7, 35, 400]].tolist() == [True] * 3 + [False]
    slow = {k: v["slow_eye_movements"] for k, v in got.items()}
    a = np.column_stack([np.ones(n), t["f_rel_delta"], t["c_log_power"]])
    plain = t["eog_low"] - a @ np.linalg.lstsq(a, t["eog_low"], rcond=None)[0]
    assert all(abs(slow[k] - plain[30 * k : 30 * k + 30].mean()) < 1e-9 for k in got) and max(slow, key=slow.get) == 10
    assert got[3]["alpha_dropout"] == 0.5 and got[4]["alpha_dropout"] == 1.0
    flat = markers.epoch_markers(df.withColumn("o_rel_alpha", F.lit(0.0)).withColumn("f_rel_delta", F.col("c_log_power"))).collect()
    assert len(flat) == 20 and all(x["alpha_dropout"] is None and x["slow_eye_movements"] is not None for x in flat)
    assert markers.epoch_markers(df.limit(0)).count() == 0


def test_array_features_are_drawn_to_the_rows(spark):
    df = spark.createDataFrame([(1, "rate", [0.0, 10.0, 0.0]), (1, "peak_Width", [1.0, 2.0]), (1, "one", [1.0]), (1, "none", None), (1, "same", [5.0, 6.0, 7.0, 8.0, 9.0])], "subject_id long, name string, samples array<double>")
    rows = lambda n: markers.array_features(df, spark.createDataFrame([(1, n)], "subject_id long, rows long")).orderBy("name", "row").collect()
    got = {}
    for r in rows(5):
        got.setdefault(r["name"], []).append(r["v"])
    assert got == {"rate": [0, 5, 10, 5, 0], "same": [5, 6, 7, 8, 9]}
    assert [(r["name"], r["v"]) for r in rows(1)] == [("rate", 0.0), ("same", 5.0)] and rows(0) == []


def test_beat_detectors():
    x = np.sin(np.arange(4000) / 20)
    assert np.array_equal(generators.beats(x, 100.0, " Adaptive"), generators.beats(x, 100.0))
    own = generators.pan_tompkins({"ecg": (x, 100.0)}, detector=lambda x, fs: [300, 100, 200, 200])
    assert np.flatnonzero(own["heartbeat_mask"][0]).tolist() == [100, 200, 300]
    with pytest.raises(ValueError):
        generators.beats(x, 100.0, "unknown")


def test_reference_of_one_and_two_data_sets(spark):
    rows = [(1, i, i % 2, float(i), 2.0) for i in range(10)]
    df = spark.createDataFrame(rows, "subject_id long, slot long, stage int, respiration__rate double, other double")
    one = reference.staging_reference({"a": df})
    assert one.table is df and one.features == ["respiration__rate"] and sorted((r["epoch_index"], r["stage"]) for r in one.staging.collect()) == [(0, 0), (1, 1)]
    two = reference.staging_reference({"a": df, "b": df.withColumn("x__eeg_1", F.lit(1))})
    assert "x__eeg_1" not in two.table.columns and two.staging.count() == 4 and set(two.staging.select("dataset").distinct().toPandas()["dataset"]) == {"a", "b"}
    assert reference.output_folder("out/", "run") == "out/run" and reference.output_folder("out", "run", ("a", "b")) == "out/run__a+b" and reference.output_folder("out") == "out"


def test_record_from_file_to_tables(spark, tmp_path):
    r = np.random.default_rng(2)
    (tmp_path / "n01.rec").write_bytes(recordings.write_edf([(c, 100, r.normal(0, 30, 100 * 60)) for c in ("C3A2", "EMG", "ECG", "Lefteye", "RightEye")]))
    tracks, tables = reference.record_features(spark, f"file://{tmp_path}", "staging")
    assert {x["subject_id"] for x in tracks.select("subject_id").distinct().collect()} == {"n01"} and tables["6s"].count() == 10
