"""Boosted trees against a plain version that goes over values one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightgrid.plans import boosting

R = np.random.default_rng(8)


def table(n=400):
    x = np.stack([R.integers(0, 12, n), R.integers(0, 5, n), R.integers(0, 30, n)], 1).astype(float)
    y = ((x[:, 0] > 5).astype(int) + (x[:, 2] > 20) * (x[:, 1] > 2)).astype(int)
    y[R.random(n) < 0.1] = 2
    x[R.random(n) < 0.1, 0] = np.nan
    x[R.random(n) < 0.05, 2] = np.nan
    return x, y, np.arange(n) % 8


def frame(spark, x, y, s):
    rows = [(int(k), *[None if np.isnan(v) else float(v) for v in r], int(c), i) for i, (r, c, k) in enumerate(zip(x, y, s))]
    return spark.createDataFrame(rows, "subject_id long, a double, b double, c double, y int, i long").repartition(3)


def plain_split(x, g, h, rows, least, l2):
    """The best split of some rows: (gain, feature, value, missing left, left rows)."""
    best = None
    total_g, total_h = g[rows].sum(), h[rows].sum()
    for f in range(x.shape[1]):
        values = sorted(set(x[rows, f][~np.isnan(x[rows, f])]))
        for v in values:
            for missing_left in (False, True):
                nan = np.isnan(x[rows, f])
                if missing_left and not nan.any():
                    continue
                left = rows[(x[rows, f] <= v) | (nan & missing_left)]
                right = np.setdiff1d(rows, left)
                if len(left) < least or len(right) < least or h[left].sum() < 1e-3 or h[right].sum() < 1e-3:
                    continue
                gain = g[left].sum() ** 2 / (h[left].sum() + l2) + g[right].sum() ** 2 / (h[right].sum() + l2) - total_g**2 / (total_h + l2)
                if gain > 1e-12 and (best is None or round(gain, 10) > round(best[0], 10)):
                    best = (gain, f, v, missing_left, left, right)
    return best


def plain_boost(x, y, rounds, depth, rate, least, l2, balanced):
    classes = sorted(set(y))
    n = np.array([(y == c).sum() for c in classes], float)
    weight = len(y) / (len(classes) * n) if balanced else np.ones(len(classes))
    w = weight[y]
    score = np.tile(np.log(n * weight / (n * weight).sum()), (len(y), 1))
    splits = []
    for _ in range(rounds):
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for c in classes:
            g, h = w * (p[:, c] - (y == c)), w * p[:, c] * (1 - p[:, c])
            leaves = [(np.arange(len(y)), 0)]
            while leaves:
                rows, d = leaves.pop()
                s = plain_split(x, g, h, rows, least, l2) if d < depth else None
                if s is None:
                    if d:
                        score[rows, c] -= rate * g[rows].sum() / (h[rows].sum() + l2)
                else:
                    splits.append((c, d, s[1], s[3], round(s[0], 6)))
                    leaves += [(s[4], d + 1), (s[5], d + 1)]
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True), splits


@pytest.mark.parametrize("balanced,l2", [(True, 0.0), (False, 1.0)])
def test_equals_a_plain_version(spark, balanced, l2):
    x, y, s = table()
    df = frame(spark, x, y, s)
    rounds = boosting.STORE_ROUNDS + 2  # beyond a stored table of scores
    model, _ = boosting.fit(df, ["a", "b", "c"], "y", rounds=rounds, depth=2, rate=0.3, least_rows=15, l2=l2, balanced=balanced)
    got = {r["i"]: r["proba"] for r in boosting.predict(model, df, ["i"]).collect()}
    want, splits = plain_boost(x, y, rounds, 2, 0.3, 15, l2, balanced)
    np.testing.assert_allclose([got[i] for i in range(len(y))], want, rtol=1e-8, atol=1e-10)
    assert sum((t.feature >= 0).sum() for r in model.trees for t in r[0]) == len(splits)


def test_gains_of_the_first_level(spark):
    x, y, s = table(200)
    df = frame(spark, x, y, s)
    prior, weight = np.log(np.bincount(y) / len(y))[None], np.ones((1, 3))
    model = boosting.Boosted(["a", "b", "c"], boosting.bin_cuts(df, ["a", "b", "c"]), [0, 1, 2], prior, weight, 1)
    bins = model.binned(x)
    rows = spark.createDataFrame([(-1, int(c), bytearray(b.tobytes()), prior.ravel().tolist()) for b, c in zip(bins, y)], "fold int, y int, bins binary, scores array<double>").repartition(4)
    parts = [rows.mapInArrow(boosting._histograms(model, 0, [[boosting.Tree.empty(1)] * 3], 0, g), boosting.HISTOGRAM) for g in ([0, 2], [1])]
    h = parts[0].unionByName(parts[1]).groupBy("model", "class", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
    best = {r["class"]: (-r["f"], round(r["gain"], 6), not r["right"]) for r in boosting.best_splits(h, 20, 0.0).collect()}
    p = np.exp(prior[0])
    for c in range(3):
        b = plain_split(x, p[c] - (y == c), np.full(len(y), p[c] * (1 - p[c])), np.arange(len(y)), 20, 0.0)
        assert best[c] == (b[1], round(b[0], 6), b[3])


def test_held_out_models_never_see_their_subjects(spark):
    x, y, s = table(600)
    y[s == 3] = 2  # a subject that only its own labels would give away
    df = frame(spark, x, y, s)
    opts = {"rounds": 3, "depth": 2, "least_rows": 10}
    out = boosting.out_of_fold(df, ["a", "b", "c"], "y", k=4, keys=["subject_id", "i", "y"], **opts)
    rows = out.collect()
    assert len(rows) == 600 and {r["fold"] for r in rows} == {0, 1, 2, 3}
    for f in {r["fold"] for r in rows}:  # the same as a model fitted without the fold
        mine = {r["subject_id"] for r in rows if r["fold"] == f}
        model, _ = boosting.fit(df.filter(~F.col("subject_id").isin(*mine)), ["a", "b", "c"], "y", **opts)
        alone = {r["i"]: r["proba"] for r in boosting.predict(model, df.filter(F.col("subject_id").isin(*mine)), ["i"]).collect()}
        np.testing.assert_allclose([r["proba"] for r in rows if r["fold"] == f], [alone[r["i"]] for r in rows if r["fold"] == f], rtol=1e-9)


def test_cuts(spark):
    df = spark.range(5000).select((F.col("id") % 7).cast("double").alias("few"), (F.col("id") * 1.5).alias("many"), F.lit(None).cast("double").alias("none"), F.lit(float("nan")).alias("nan"), F.lit(3).alias("one"))
    few, many, none, nan, one = boosting.bin_cuts(df, ["few", "many", "none", "nan", "one"])
    assert few.tolist() == [0, 1, 2, 3, 4, 5] and len(none) == len(nan) == len(one) == 0
    assert len(many) <= 254 and abs(np.searchsorted(many, 3750.0) - 127) <= 2


def test_importance_and_empty(spark):
    x, y, s = table(500)
    df = frame(spark, x, (x[:, 2] > 15).astype(int), s)
    drops = dict(boosting.permutation_importance(df, {"a and b": ["a", "b"], "c": ["c"]}, "y", k=3, rounds=4, depth=2))
    assert drops["c"] > 0.2 and abs(drops["a and b"]) < 0.1
    model, _ = boosting.fit(df, ["a", "c"], "y", rounds=2, depth=2)
    assert boosting.predict(model, df.limit(0), ["i"]).collect() == []
    missing = boosting.predict(model, df.withColumns({"a": F.lit(None).cast("double"), "c": F.lit(float("nan"))}), ["i"])
    assert missing.select(F.round(F.col("proba")[0], 9)).distinct().count() == 1
