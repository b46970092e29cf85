"""Leave-one-subject-out selection against refitting on each fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightgrid.plans import selection

R = np.random.default_rng(6)
NAMES = ["good", "second", "noise", "copy", "gaps"]


@pytest.fixture(scope="module")
def data():
    rows = []
    for s in range(9):
        for i in range(40 if s else 1):  # one subject has a single row
            y = int(R.integers(0, 3)) if s != 4 else int(R.integers(0, 2))
            good = y + R.normal(0, 0.6) + 10 * s
            rows.append((s, y, good, (y == 1) * 1.2 + R.normal(0, 0.8), R.normal(), good, R.normal() + 0.3 * y if R.random() < 0.7 else None))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "subject_id long, y int, good double, second double, noise double, copy double, gaps double").repartition(4)


def refit(rows, use):
    """The mean score with a model fitted anew for each subject, in plain terms."""
    s = np.array([r[0] for r in rows])
    y = np.array([r[1] for r in rows])
    x = np.array([[np.nan if v is None else v for v in r[2:]] for r in rows], float)
    for k in np.unique(s):
        q = np.nanpercentile(x[s == k], [25, 50, 75], axis=0)
        scale = np.where(q[2] > q[0], q[2] - q[0], 1)
        x[s == k] = (x[s == k] - q[1]) / scale
    x = np.nan_to_num(x)[:, use]
    out = []
    for k in np.unique(s):
        a, b = s != k, s == k
        if b.sum() < 2:
            continue
        classes = np.unique(y[a])
        mean = np.array([x[a & (y == c)].mean(0) for c in classes])
        inner = np.concatenate([x[a & (y == c)] - m for c, m in zip(classes, mean)])
        cov = inner.T @ inner / (a.sum() - len(classes))
        cov += np.eye(len(use)) * selection.RIDGE * np.trace(cov) / len(use)
        inv = np.linalg.inv(cov)
        d = [x[b] @ inv @ m - m @ inv @ m / 2 + np.log((y[a] == c).mean()) for c, m in zip(classes, mean)]
        p = classes[np.argmax(d, 0)]
        f1 = []
        for c in sorted(set(y[b]) | set(p)):
            tp, wrong = ((p == c) & (y[b] == c)).sum(), ((p == c) != (y[b] == c)).sum()
            f1.append(2 * tp / (2 * tp + wrong))
        out.append(np.mean(f1))
    return np.mean(out)


def test_scores_equal_refitting(spark, data):
    rows = selection.scaled_rows(frame(spark, data), NAMES, "y", [0, 1, 2])
    every = selection.moments(rows, 5, 3)
    sets = [[0], [1], [0, 1], [0, 1, 2, 4], [0, 3]]
    got = {r["candidate"]: r["f1"] for r in selection.left_out_scores(rows, every, sets).groupBy("candidate").agg(F.avg("f1").alias("f1")).collect()}
    for k, use in enumerate(sets):
        assert got[k] == pytest.approx(refit(data, use), abs=1e-9)


@pytest.mark.parametrize("mode", ["greedy", "auc_rank"])
def test_steps_equal_a_plain_search(spark, data, mode):
    ranking = ["second", "good", "noise", "copy", "gaps"]
    out = selection.select_features(frame(spark, data), NAMES, "y", mode, most=3, least_pct=-100.0, ranking=ranking).orderBy("step").collect()
    y = [r[1] for r in data]
    top = max((y.count(c), -c) for c in set(y))[0]
    assert out[0]["added_feature"] == selection.BASELINE and out[0]["cumulative_macro_f1"] == pytest.approx(2 * top / (top + len(y)) / 3) and out[0]["delta_f1"] is None
    chosen, left = [], list(ranking)
    for r in out[1:]:
        tried = [(refit(data, [NAMES.index(c) for c in (*chosen, f)]), -k, f) for k, f in enumerate(left[:1] if mode == "auc_rank" else left)]
        best = max(tried)
        assert r["added_feature"] == best[2] and r["cumulative_macro_f1"] == pytest.approx(best[0], abs=1e-9) and r["mode"] == mode
        chosen.append(best[2])
        left.remove(best[2])
    assert len(out) == 4 and out[2]["delta_f1"] == pytest.approx(out[2]["cumulative_macro_f1"] - out[1]["cumulative_macro_f1"])


def test_ends_and_limits(spark, data):
    df = frame(spark, data)
    stopped = selection.select_features(df, NAMES, "y", least_pct=5.0).orderBy("step").collect()
    assert stopped[1]["added_feature"] in ("good", "copy") and stopped[-1]["delta_f1_pct"] < 5.0 and all(r["delta_f1_pct"] >= 5.0 for r in stopped[1:-1])
    pooled = selection.select_features(df, NAMES, "y", pool=2, least_pct=-100.0, ranking=["noise", "good", "second"])
    assert {r["added_feature"] for r in pooled.collect()} == {selection.BASELINE, "good", "noise"}
    assert selection.select_features(df.limit(0), NAMES, "y").count() == 0 and selection.select_features(df, [], "y", ranking=[]).count() == 0
    with pytest.raises(ValueError):
        selection.select_features(df, NAMES, "y", mode="best")
