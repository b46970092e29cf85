"""The polyphase resampler and the data sets' track loaders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightgrid.functions import resampling as rs
from nightgrid.sources import recordings

R = np.random.default_rng(4)


def plain(x, up, down):
    """Every output as a sum over all inputs."""
    h = rs.taps(up, down)
    mid, n = len(h) // 2, -(-len(x) * up // down)
    return np.array([sum(x[i] * h[m * down - i * up + mid] for i in range(len(x)) if 0 <= m * down - i * up + mid < len(h)) for m in range(n)])


@pytest.mark.parametrize("up,down", [(8, 1), (3, 2), (2, 5), (1, 4), (1, 1), (25, 32)])
def test_equals_the_sum(up, down):
    x = R.normal(0, 1, 130)
    np.testing.assert_allclose(rs.polyphase(x, up, down), plain(x, up, down), atol=1e-12)
    # in pieces with their neighbours' edges
    e, parts = rs.reach(up, down) + 1, []
    for a in range(0, 130, 37):
        b = min(a + 37, 130)
        lo, hi = max(0, a - e), min(130, b + e)
        parts.append(rs.polyphase(x[lo:hi], up, down, a, a - lo, hi - b))
    np.testing.assert_allclose(np.concatenate(parts), plain(x, up, down), atol=1e-12)


@pytest.mark.parametrize("fs,to,hz", [(25, 200, 0.3), (25, 200, 5.0), (128, 200, 10.0), (256, 200, 30.0)])
def test_tones_keep_amplitude_and_phase(fs, to, hz):
    up, down = rs.factors(fs, to)
    y = rs.polyphase(np.sin(2 * np.pi * hz * np.arange(fs * 60) / fs + 0.4), up, down)
    want = np.sin(2 * np.pi * hz * np.arange(len(y)) / to + 0.4)
    assert len(y) == to * 60 and np.abs(y - want)[to * 2 : -to * 2].max() < 0.01


def test_what_the_lower_rate_cannot_hold_is_gone():
    y = rs.polyphase(np.sin(2 * np.pi * 90 * np.arange(256 * 20) / 256), *rs.factors(256, 100))
    assert np.abs(y)[200:-200].max() < 0.01


def chunk_rows(subject, channel, fs, x, seconds, lane=0):
    step = max(1, int(fs * seconds))
    return [(subject, channel, lane, c, float(fs), "uV", x[a : a + step].tolist()) for c, a in enumerate(range(0, len(x), step))]


SCHEMA = recordings.SCHEMA.replace("chunk_id", "lane int, chunk_id")


def test_chunk_borders_do_not_show(spark):
    x = {("a", "belt", 25): R.normal(0, 1, 25 * 33), ("b", "belt", 25): R.normal(0, 1, 25 * 10), ("a", "eeg", 200): R.normal(0, 1, 200 * 7), ("a", "slow", 8): R.normal(0, 1, 8 * 20)}
    rows = [r for (s, c, fs), v in x.items() for r in chunk_rows(s, c, fs, v, 5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = rs.resample(df, 200, ["belt", "eeg", "slow"], chunk_seconds=5)
    assert out.columns == df.columns and out.select("fs").distinct().collect() == [(200.0,)]
    got = {}
    for r in out.orderBy("chunk_id").collect():
        got.setdefault((r["subject_id"], r["channel"]), []).append(r["samples"])
    for (s, c, fs), v in x.items():
        np.testing.assert_allclose(np.concatenate(got[s, c]), v if fs == 200 else plain(v, *rs.factors(fs, 200)), atol=1e-10)
    short = rs.resample(df.filter("channel = 'slow'"), 1.0, chunk_seconds=5)  # the filter reaches over several chunks
    np.testing.assert_allclose(np.concatenate([r["samples"] for r in short.orderBy("chunk_id").collect()]), plain(x["a", "slow", 8], 1, 8), atol=1e-10)
    assert rs.resample(df.limit(0), 50).collect() == []


def test_a_missing_chunk_counts_as_zeros(spark):
    x = R.normal(0, 1, 100)
    rows = [r for r in chunk_rows("a", "belt", 10, x, 2) if r[3] != 2]
    got = {r["chunk_id"]: r["samples"] for r in rs.resample(spark.createDataFrame(rows, SCHEMA), 20, chunk_seconds=2).collect()}
    x[40:60] = 0
    want = plain(x, 2, 1)
    for c in (0, 1, 3, 4):
        np.testing.assert_allclose(got[c], want[c * 40 : c * 40 + 40], atol=1e-10)


def test_loaders_agree_on_what_they_share(spark):
    """One night at 200 Hz, its belts at 25 Hz for one loader: shared columns are equal."""
    n, fs = 60, 200
    t = np.arange(n * fs) / fs
    eeg, eeg2 = (20 * np.sin(2 * np.pi * 6 * t) + R.normal(0, 2, t.size) for _ in range(2))
    ecg = sum(np.exp(-((t - b) ** 2) / (2 * 0.012**2)) for b in np.arange(0.5, n, 0.8))
    own = {"eeg": eeg, "eeg2": eeg2, "eog_left": R.normal(0, 5, t.size), "eog_right": R.normal(0, 5, t.size), "emg": R.normal(0, 5, t.size), "ecg": ecg, "eeg_frontal": eeg, "eeg_occipital": eeg2}
    belt = lambda f: np.sin(2 * np.pi * 0.25 * np.arange(n * f) / f)
    base = [r for c, v in own.items() for r in chunk_rows("s", c, fs, v, 300)]
    nights = {f: spark.createDataFrame(base + [r for c in ("effort_thoracic", "effort_abdominal") for r in chunk_rows("s", c, f, belt(f), 300)], SCHEMA) for f in (200, 25)}
    tracks = {}
    for name, night in (("cinc2018", nights[200]), ("isruc", nights[25]), ("ucddb", nights[25])):
        tracks[name] = {}
        for r in rs.dataset_tracks(name, night).orderBy("idx").collect():
            tracks[name].setdefault(r["signal"], []).append(r["v"])
    assert set(tracks["cinc2018"]) == set(tracks["isruc"]) > set(tracks["ucddb"]) == set(rs.SHARED) and len(tracks["isruc"]) == 14
    for c in rs.SHARED:
        a, b, d = (np.array(tracks[k][c], float) for k in ("cinc2018", "isruc", "ucddb"))
        tight = not c.startswith("resp_")
        np.testing.assert_allclose(b[5:-5], a[5:-5], rtol=1e-6 if tight else 0.02, atol=1e-6 if tight else 0.02)
        if tight:
            np.testing.assert_allclose(d, a, rtol=1e-5, atol=1e-6)
    with pytest.raises(ValueError):
        rs.dataset_tracks("other", nights[25])
