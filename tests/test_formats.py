"""EDF and WFDB data sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightgrid.sources import formats, recordings

R = np.random.default_rng(5)


def by_key(df):
    return {(r["subject_id"], r["channel"], r["chunk_id"]): r for r in df.collect()}


def same(a, b):
    a, b = by_key(a), by_key(b)
    assert a.keys() == b.keys()
    for k in a:
        assert a[k]["fs"] == b[k]["fs"] and a[k]["units"] == b[k]["units"] and np.allclose(a[k]["samples"], b[k]["samples"], rtol=0, atol=1e-12)


@pytest.fixture
def nights(tmp_path):
    """Two nights; the records of one are 7 s, so chunks of 300 s begin inside records."""
    for name, seconds, n in (("a.edf", 1.0, 1500), ("b.rec", 7.0, 200)):
        per = [int(64 * seconds), int(1 * seconds), int(10 * seconds)]
        signals = [(c, p, R.normal(0, 50, p * n)) for c, p in zip(("C3-A2", "SpO2", "Chin1-Chin2"), per)]
        (tmp_path / name).write_bytes(recordings.write_edf(signals, seconds))
    return f"file://{tmp_path}"


def test_edf_scan_equals_whole_files(spark, nights):
    whole = recordings.read_edf(spark, nights)
    same(formats.scan_edf(spark, nights), whole)
    split = formats.scan_edf(spark, nights, partitionBytes="40000")
    assert split.rdd.getNumPartitions() > 8
    same(split, whole)
    same(formats.scan_edf(spark, nights, low_gain_below=1e9), recordings.read_edf(spark, nights, 1e9))


def test_a_scan_reads_what_it_is_for(spark, nights):
    df = formats.scan_edf(spark, nights, partitionBytes="40000")
    some = formats.scan_edf(spark, nights, subjects=["b"], channels=["spo2", "eeg"], chunks=(2, 4), partitionBytes="40000")
    same(some, recordings.read_edf(spark, nights).filter("subject_id = 'b' AND channel IN ('spo2', 'eeg') AND chunk_id >= 2 AND chunk_id < 4"))
    assert some.rdd.getNumPartitions() < df.rdd.getNumPartitions()
    # conditions on a frame leave later queries on it alone
    n = df.count()
    assert df.filter("channel = 'spo2' AND size(samples) = 300").count() == 9 and df.filter("subject_id = 'a'").count() < n and df.count() == n
    assert formats.scan_edf(spark, nights, channels=["none"]).count() == 0 and formats.scan_edf(spark, nights, subjects=[]).count() == 0


def test_reader_plans_only_what_is_asked(nights):
    r = formats.EdfReader({"path": nights, "subjects": '["a"]', "channels": '["spo2"]', "fromChunk": "4"})
    parts = r.partitions()
    assert [(p.recording.subject, p.low, p.high) for p in parts] == [("a", 4, 5)] and [parts[0].recording.signals[k].channel for k in parts[0].wanted] == ["spo2"]
    assert sum(b.num_rows for b in r.read(parts[0])) == 1


def test_a_task_never_holds_the_file(spark, tmp_path, monkeypatch):
    """40 MB of records by ranges; every read is of a bounded stretch."""
    n, fs = 10_000, 1000
    head = formats.edf_header([("EMG", fs, "uV", -32768, 32767, -32768, 32767), ("ECG", fs, "uV", -32768, 32767, -32768, 32767)], n, 1.0)
    with open(tmp_path / "long.edf", "wb") as f:
        f.write(head)
        for k in range(n):
            f.write((np.arange(2 * fs) % 100 + k % 7).astype("<i2").tobytes())
    df = formats.scan_edf(spark, f"file://{tmp_path}", partitionBytes=str(4 << 20))
    got = df.groupBy("channel").agg(F.sum(F.size("samples")).alias("n"), F.sum(F.aggregate("samples", F.lit(0.0), lambda a, b: a + b)).alias("total"))
    want = sum((np.arange(2 * fs) % 100 + k % 7).reshape(2, fs).sum(1) for k in range(n)).tolist()
    assert {r["channel"]: (r["n"], r["total"]) for r in got.collect()} == {"emg": (n * fs, want[0]), "ecg": (n * fs, want[1])}
    r = formats.EdfReader({"path": f"file://{tmp_path}", "partitionBytes": str(4 << 20)})
    parts = r.partitions()
    assert len(parts) > 8 and max(p.high - p.low for p in parts) * 300 * 2 * fs * 2 <= 8 << 20


def test_a_lifecard_file_is_the_fallback(spark, tmp_path):
    make = lambda v: recordings.write_edf([("ECG", 10, np.full(100, float(v)))])
    (tmp_path / "ucddb002.rec").write_bytes(make(1))
    (tmp_path / "ucddb002_lifecard.edf").write_bytes(make(2))
    (tmp_path / "ucddb003_lifecard.edf").write_bytes(make(3))
    path = f"file://{tmp_path}"
    for df in (formats.scan_edf(spark, path), recordings.read_edf(spark, path)):
        assert {r["subject_id"]: round(r["samples"][0]) for r in df.collect()} == {"ucddb002": 1, "ucddb003": 3}


def test_unknown_number_of_records_and_cut_files(spark, tmp_path):
    data = bytearray(recordings.write_edf([("ECG", 10, np.arange(100.0))]))
    data[236:244] = b"-1      "
    (tmp_path / "x.edf").write_bytes(bytes(data[:-7]))
    df = formats.scan_edf(spark, str(tmp_path))
    assert df.select(F.size("samples")).first()[0] == 90
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "none.edf").write_bytes(bytes(data[: 512]))
    assert formats.scan_edf(spark, str(tmp_path / "e")).count() == 0


def test_wfdb_scan_equals_whole_files(spark, tmp_path):
    for name, ext, off in (("tr01", "mat", 24), ("tr02", "dat", 0)):
        raw = R.integers(-3000, 3000, (200 * 700, 3)).astype("<i2")
        fmt = f"16+{off}" if off else "16"
        lines = [f"{name} 3 200 {len(raw)}"] + [f"{name}.{ext} {fmt} {g}({z})/uV 16 0 0 0 0 {c}" for g, z, c in ((10, 0, "C3-M2"), (5, 10, "ABD"), (1, -3, "SaO2"))]
        (tmp_path / f"{name}.hea").write_text("\n".join(lines) + "\n# comment\n")
        (tmp_path / f"{name}.{ext}").write_bytes(b"\0" * off + raw.tobytes())
    (tmp_path / "lone.hea").write_text("lone 1 10 5\nlone.dat 16 1/mV 16 0 0 0 0 ECG\n")
    path = f"file://{tmp_path}"
    df = formats.scan_wfdb(spark, path, partitionBytes="200000")
    same(df, recordings.read_wfdb(spark, path))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    same(formats.scan_wfdb(spark, path, subjects=["tr02"], channels=["spo2"]), recordings.read_wfdb(spark, path).filter("subject_id = 'tr02' AND channel = 'spo2'"))


@pytest.mark.parametrize("kind", ["edf", "wfdb"])
def test_saved_recordings_come_back(spark, tmp_path, kind):
    df = spark.createDataFrame([(s, i, (i * 7 + s) % 200 - 50, i % 5) for s in (1, 2) for i in range(1000)], "subject_id long, i long, k int, stage int").repartition(5)
    assert formats.save_whole_numbers(df, str(tmp_path), ("k", "stage"), kind, fs=2).count() == (2 if kind == "edf" else 4)
    scan = formats.scan_edf(spark, str(tmp_path)) if kind == "edf" else formats.scan_wfdb(spark, str(tmp_path))
    x = scan.select("subject_id", "channel", "chunk_id", F.posexplode("samples").alias("j", "v"))
    got = {(r[0], r[1], r[2] * 600 + r[3]): round(r[4]) for r in x.collect()}
    assert got == {(str(r["subject_id"]), c, r["i"]): r[c] for r in df.collect() for c in ("k", "stage")}
