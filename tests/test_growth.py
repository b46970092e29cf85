"""What must not grow with the tables: what comes to the driver, and what a task holds."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stream_results_are_stored_tables(spark):
    from nightgrid.plans import signals

    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    out = signals.stream_tumbling(spark, SF)
    assert out.inputFiles(), "a stream's result must not be a table of the driver"
    n = out.agg(F.sum("n")).first()[0]
    assert n == spark.read.parquet(f"{SF}/events.parquet").count()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    assert signals.stream_sessions(spark, SF).inputFiles()


def test_whole_part_of_a_mean_does_not_hang_on_the_order_of_its_sum(spark, monkeypatch):
    from nightgrid.plans import trees

    means = spark.createDataFrame([(1, 0, 14 - 2e-15, 14 + 2e-15, 1), (1, 1, 13.99, 250.0, 2)], "subject_id long, epoch_index long, v double, k double, stage int")
    monkeypatch.setattr(trees, "epochs", lambda *_: means)
    assert [(r["a"], r["b"]) for r in trees.whole_numbers(spark, SF).orderBy("epoch_index").collect()] == [(14.0, 14.0), (13.0, 200.0)]


def test_long_series_are_recordings_back_to_back(spark, monkeypatch):
    from nightgrid.functions import generators
    from nightgrid.plans import signals

    whole = signals.chunks(spark, SF).groupBy("subject_id", "channel").count().filter("channel = 'eog'")
    assert "start_us" in signals.chunks(spark, SF).columns
    want = {r["subject_id"]: r["count"] for r in whole.collect()}
    monkeypatch.setattr(signals, "NIGHT", 120)
    c = signals.chunks(spark, SF)
    sizes = c.filter("channel = 'eog'").groupBy("subject_id", "start_us").count().collect()
    assert {120} <= {r["count"] for r in sizes} and max(r["count"] for r in sizes) < 240
    t = generators.run_generator(c, "eye_movement_activity").filter("signal = 'eye_movement_activity'")
    got = t.groupBy("subject_id").agg(F.count("*").alias("n"), F.count_distinct("idx").alias("places"), F.max("idx").alias("last"), F.max(F.col("t_us") - F.round(F.col("idx") / 64 * 1e6)).alias("off")).collect()
    assert {r["subject_id"]: r["n"] for r in got} == {k: 64 * n for k, n in want.items()}
    assert all(r["places"] == r["n"] == r["last"] + 1 and abs(r["off"]) <= 1 for r in got)
    beats = generators.run_events(c, ("pan_tompkins",))
    assert beats.filter("abs(start_us - start / 64 * 1e6) > 1").count() == 0 and beats.agg(F.max("start")).first()[0] > 240 * 64


def test_kernels_hold_some_frames_at_a_time():
    import tracemalloc

    import numpy as np

    from nightgrid.functions import dsp, generators

    x = np.random.default_rng(0).normal(size=64 * 3600)
    tracemalloc.start()
    generators.eog_rem_features({"eog": (x, 64.0)})
    generators._median_of([x] * 4)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    size, seen = 128, list(dsp.magnitude_blocks(x, 64.0, 128, 0.9))
    assert len(seen) > 1 and sum(map(len, seen)) == len(dsp.spectrogram_grid(len(x), 64.0, size, 0.9)[1])


def test_beats_look_at_the_whole_recording_once(monkeypatch):
    import numpy as np

    from nightgrid.functions import dsp

    t = np.arange(64 * 120) / 64
    calls, median = [], np.median
    monkeypatch.setattr(np, "median", lambda v, *a, **k: calls.append(len(v)) or median(v, *a, **k))
    assert len(dsp.r_peaks(np.exp(-(((t % 1) - 0.5) / 0.015) ** 2 / 2), 64.0)) > 100
    assert calls.count(len(t)) <= 1


def test_feature_table_reads_stored_rows(spark):
    from nightgrid.functions import generators

    t = spark.createDataFrame([(1, "a", "x", 0, 0, "au", 1.0), (1, "a", "x", 1, 6_000_000, "au", 3.0)], f"subject_id long, {generators.TRACK_SCHEMA}")
    out = generators.feature_table(t)
    assert [r["a__x"] for r in out.orderBy("row").collect()] == [1.0, 3.0]
    assert all("track-rows" in f for f in out.inputFiles()) and out.inputFiles()


def test_many_small_recordings_share_partitions(tmp_path):
    import numpy as np

    from nightgrid.sources import formats, recordings

    for k in range(200):
        (tmp_path / f"s{k}.edf").write_bytes(recordings.write_edf([("ECG", 1, np.arange(5.0) + k), ("EMG", 1, np.arange(5.0) - k)]))
    r = formats.EdfReader({"path": str(tmp_path), "parallelism": "8", "channels": '["emg"]'})
    parts = r.partitions()
    assert 8 <= len(parts) <= 16
    rows = [row for p in parts for b in r.read(p) for row in b.to_pylist()]
    assert sorted(x["subject_id"] for x in rows) == sorted(f"s{k}" for k in range(200)) and {x["channel"] for x in rows} == {"emg"}
    only = formats.EdfReader({"path": str(tmp_path), "parallelism": "8", "subjects": '["s7"]'})
    assert [p.recording.subject for p in only.partitions()] == ["s7"]


def _noise(seconds):
    import numpy as np

    return np.random.default_rng(1).normal(size=64 * seconds).cumsum() % 7 - 3


def test_kernels_need_little_room_beside_their_results():
    import tracemalloc

    from nightgrid.functions import generators

    x = _noise(3 * 3600)
    for name, channel, times in (("emg_tone_features", "emg", 8), ("slow_wave_features", "eeg", 9), ("spo2_drop", "spo2", 8), ("airflow_morphology", "flow", 6)):
        tracemalloc.start()
        generators.GENERATORS[name][2]({channel: (x, 64.0)})
        peak = tracemalloc.get_traced_memory()[1] / x.nbytes
        tracemalloc.stop()
        assert peak < times, (name, peak)


def test_stretches_of_a_recording_give_what_the_whole_gives(monkeypatch):
    import numpy as np

    from nightgrid.functions import dsp, generators

    x = _noise(1200)
    every = {c: (np.roll(x, 999 * i), 64.0) for i, c in enumerate(("eeg", "eog", "emg", "ecg", "effort_sum", "effort_thoracic", "effort_abdominal", "flow", "airflow_pressure", "spo2", "snore"))}
    names = ("emg_tone_features", "slow_wave_features", "spo2_drop", "airflow_morphology", "respiration", "apnea_events", "effort_snore_features", "channel_quality", "epoch_ratio_features", "one_second_tracks")
    run = lambda: {n: generators.GENERATORS[n][2]({c: every[c] for c in generators.GENERATORS[n][2].channels if c in every}) for n in names}
    whole = run()
    monkeypatch.setattr(dsp, "STRETCH", 1 << 12)
    for n, tracks in run().items():
        assert tracks.keys() == whole[n].keys()
        for k, (v, *_) in tracks.items():
            assert np.allclose(np.asarray(v, float), np.asarray(whole[n][k][0], float), rtol=1e-9, atol=1e-7, equal_nan=True), (n, k)


def test_recordings_are_put_together_batch_by_batch():
    import numpy as np
    import pyarrow as pa

    from nightgrid.functions import generators

    rows = [{"start_us": s, "channel": c, "lane": lane, "chunk_id": k, "fs": 2.0, "units": "uV", "samples": [1000.0 * lane + 10 * k, None] if k % 2 else [10.0 * k]} for s in (60, 0) for k in range(5) for c, lane in (("b", 0), ("a", 1), ("a", 0))]
    rows.append({"start_us": 0, "channel": "b", "lane": 0, "chunk_id": 9, "fs": 2.0, "units": "uV", "samples": None})
    rows = [rows[i] for i in np.random.default_rng(0).permutation(len(rows))]
    schema = pa.schema([("start_us", pa.int64()), ("channel", pa.string()), ("lane", pa.int32()), ("chunk_id", pa.int64()), ("fs", pa.float64()), ("units", pa.string()), ("samples", pa.list_(pa.float64()))])
    read, taken = [], pa.Table.from_pylist(rows, schema).to_batches(7)
    (first, ch, units), (second, *_) = generators._recordings(read.append(len(b)) or b for b in taken)
    want = [0, 10, np.nan, 20, 30, np.nan, 40]
    assert (first, second, len(read)) == (0, 60, 5) and units == {"a": "uv", "b": "uv"} and ch["b"][1] == 2.0
    assert np.array_equal(ch["b"][0], want, equal_nan=True) and np.array_equal(ch["a"][0][:, 0], want, equal_nan=True) and ch["a"][0][1, 1] == 1010


def test_events_of_each_generator_are_tasks_of_their_own(spark):
    from nightgrid.functions import generators
    from nightgrid.plans import signals

    c, names = signals.chunks(spark, SF), ("pan_tompkins", "spo2_drop")
    both = generators.run_events(c, names)
    assert "algo" in str(both._jdf.queryExecution().analyzed()).split("FlatMapGroupsInArrow")[1].split("]")[0]
    alone = [r for n in names for r in generators.run_events(c, (n,)).collect()]
    assert sorted(both.collect()) == sorted(alone) and {r["algo"] for r in alone} == set(names)


def test_coupling_works_on_many_windows_at_once(monkeypatch):
    import numpy as np

    from nightgrid.functions import dsp, generators

    rng = np.random.default_rng(2)
    fs, seconds = 10.0, 600.0
    t = np.cumsum(rng.uniform(0.7, 1.1, 640))
    t = t[t < seconds]
    rr, ok = np.diff(t) * 1000, rng.random(len(t) - 1) > 0.05
    effort = np.sin(2 * np.pi * 0.25 * np.arange(int(fs * seconds)) / fs) + rng.normal(size=int(fs * seconds))
    calls, rfft = [], np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda *a, **k: calls.append(1) or rfft(*a, **k))
    got = generators.coupling(t[1:], rr, ok, effort, fs, seconds)
    assert np.isfinite(got).sum() > 300 and len(calls) < 20
    monkeypatch.setattr(dsp, "STRETCH", 4096)
    assert np.allclose(got, generators.coupling(t[1:], rr, ok, effort, fs, seconds), rtol=1e-12, equal_nan=True)
    # window by window
    grid = np.arange(0, seconds, 0.25)
    beat = np.interp(grid, t[1:][ok], rr[ok])
    breath = np.interp(grid, np.arange(len(effort)) / fs, dsp.bandpass(effort - effort.mean(), fs, 0.1, 0.7, order=2))
    for k in np.flatnonzero(np.isfinite(got))[::50]:
        s = slice(int(4 * k - 238), int(4 * k + 242))
        f, p = dsp.welch(breath[s], 4, 128)
        top = 4 + p[(f >= 0.1) & (f <= 0.5)].argmax()
        assert abs(got[k] - dsp.coherence(dsp.detrended(beat[s]), breath[s], 4, 128)[1][top - 1 : top + 2].mean()) < 1e-9


def test_beats_ask_for_slopes_only_where_beats_are_close(monkeypatch):
    import numpy as np

    from nightgrid.functions import dsp

    t = np.arange(64 * 120) / 64
    calls, gradient = [], np.gradient
    monkeypatch.setattr(np, "gradient", lambda v, *a, **k: calls.append(len(v)) or gradient(v, *a, **k))
    assert len(dsp.r_peaks(np.exp(-(((t % 1) - 0.5) / 0.015) ** 2 / 2), 64.0)) > 100
    assert len(calls) < 20


def test_kernels_of_several_channels_need_room_for_a_few_copies_of_one():
    import tracemalloc

    import numpy as np

    from nightgrid.functions import generators

    x = _noise(3 * 3600)
    for name, channels, times in (("apnea_events", ("flow", "airflow_pressure", "spo2"), 10), ("spindle_features", ("eeg",), 7), ("channel_quality", ("eeg", "ecg"), 8)):
        every = {c: (np.roll(x, 999 * i), 64.0) for i, c in enumerate(channels)}
        tracemalloc.start()
        generators.GENERATORS[name][2](every)
        peak = tracemalloc.get_traced_memory()[1] / x.nbytes
        tracemalloc.stop()
        assert peak < times, (name, peak)


#: Most that a generator may hold, in copies of a channel; behind it, what it held at the start of round 3.
ROOM = [
    ("apnea_events", ("flow", "airflow_pressure", "spo2"), 10),  # 13.9
    ("slow_wave_features", ("eeg",), 7),  # 9.0
    ("airflow_morphology", ("flow",), 4.3),  # 5.0
    ("spindle_features", ("eeg",), 7),  # 26.1
    ("channel_quality", ("eeg", "ecg"), 7.4),  # 8.3
]


@pytest.mark.parametrize("name, channels, times", ROOM)
def test_a_night_takes_a_few_copies_of_a_channel(name, channels, times):
    import tracemalloc

    import numpy as np

    from nightgrid.functions import generators

    x = _noise(3 * 3600)
    every = {c: (np.roll(x, 999 * i), 64.0) for i, c in enumerate(channels)}
    tracemalloc.start()
    generators.GENERATORS[name][2](every)
    peak = tracemalloc.get_traced_memory()[1] / x.nbytes
    tracemalloc.stop()
    assert peak < times
