"""Feature selection with each subject left out in turn, from sufficient statistics (survey M25).

The model is a Gaussian per class with one covariance (linear discriminant). All that it learns is sums: rows, values by class, products of values. Those of all subjects less one's own are
that subject's fold, so nothing is fitted again: one pass over the rows scores every candidate in every fold, a task working out one subject's rows at a time.

Values are scaled within their subject (median, quartiles), which no fold can leak; a missing value is the subject's median. Per step one aggregation over (subject, candidate);
what the driver holds grows with features, not with rows or subjects.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightgrid.operators.binning import clean
from nightgrid.sources.scratch import written

from .experiments import auc_ranking

BASELINE = "__baseline__"
#: Share of the mean variance that is put on the covariance's diagonal, so that equal columns do no harm.
RIDGE = 1e-6
#: Rows that a fold must have in training, and in the subject left out.
LEAST_TRAIN, LEAST_HELD = 10, 2


@dataclass
class Moments:
    """Rows and sums by class, and products over all rows."""

    n: np.ndarray
    sums: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, classes: int) -> "Moments":
        n = np.bincount(y, minlength=classes).astype(float)
        sums = np.stack([np.bincount(y, weights=c, minlength=classes) for c in x.T], 1) if x.shape[1] else np.zeros((classes, 0))
        return cls(n, sums, x.T @ x)

    def less(self, other: "Moments") -> "Moments":
        return Moments(self.n - other.n, self.sums - other.sums, self.products - other.products)

    def predict(self, x: np.ndarray, use: list[int]) -> np.ndarray:
        """Classes of rows by the model on the columns ``use``."""
        there = self.n > 0
        mean = self.sums[there][:, use] / self.n[there, None]
        scatter = self.products[np.ix_(use, use)] - (mean * self.n[there, None]).T @ mean
        cov = scatter / max(self.n.sum() - there.sum(), 1)
        cov[np.diag_indices(len(use))] += RIDGE * max(np.trace(cov) / len(use), 1e-12)
        w = np.linalg.solve(cov, mean.T)
        score = x[:, use] @ w - (mean.T * w).sum(0) / 2 + np.log(self.n[there])
        return np.flatnonzero(there)[score.argmax(1)]


def macro_f1(truth: np.ndarray, pred: np.ndarray, classes: int) -> float:
    """Over the classes that are in either; 0 where a class is never right."""
    hit = np.bincount(truth[truth == pred], minlength=classes)
    both = np.bincount(truth, minlength=classes) + np.bincount(pred, minlength=classes)
    seen = both > 0
    return float((2 * hit[seen] / both[seen]).mean())


def scaled_rows(df: DataFrame, features: list[str], label: str, classes: list[int], subject: str = "subject_id") -> DataFrame:
    """``subject, y, x``: each subject's values by its own medians and quartiles, in one aggregation for all features."""
    q = df.groupBy(subject).agg(*[F.percentile(clean(f), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q{k}") for k, f in enumerate(features)])
    one = lambda k, f: F.coalesce((clean(f) - F.col(f"_q{k}")[1]) / F.when(F.col(f"_q{k}")[2] > F.col(f"_q{k}")[0], F.col(f"_q{k}")[2] - F.col(f"_q{k}")[0]).otherwise(1.0), F.lit(0.0))
    y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1
    return df.filter(F.col(label).isin(classes)).join(q, subject).select(subject, y.alias("y"), F.array(*[one(k, f) for k, f in enumerate(features)]).alias("x"))


def moments(rows: DataFrame, n_features: int, classes: int) -> Moments:
    """Of all rows: tasks add up their own, Spark adds those up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = None
        for b in batches:
            if b.num_rows:
                m = Moments.of(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1), b.column(0).to_numpy(), classes)
                every = m if every is None else Moments(every.n + m.n, every.sums + m.sums, every.products + m.products)
        if every is not None:
            flat = np.concatenate([every.n, every.sums.ravel(), every.products.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

    flat = np.zeros(classes + classes * n_features + n_features**2)
    for r in rows.select("y", "x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        flat[r["i"]] = r["v"]
    n, sums, products = np.split(flat, [classes, classes + classes * n_features])
    return Moments(n, sums.reshape(classes, n_features), products.reshape(n_features, n_features))


def left_out_scores(rows: DataFrame, every: Moments, candidates: list[list[int]], subject: str = "subject_id") -> DataFrame:
    """``subject, candidate, f1``: each candidate's columns, learned from all other subjects and scored on this one."""
    classes = len(every.n)
    kind = rows.schema[subject].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        y = table.column("y").to_numpy().astype(np.int64)
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
        train = every.less(Moments.of(x, y, classes))
        fits = len(y) >= LEAST_HELD and train.n.sum() >= LEAST_TRAIN
        f1 = [macro_f1(y, train.predict(x, use), classes) for use in candidates] if fits else []
        who = table.column(subject).combine_chunks().take(pa.array([0] * len(f1), pa.int64()))
        return pa.table({subject: who, "candidate": pa.array(range(len(f1)), pa.int32()), "f1": pa.array(f1, pa.float64())})

    return rows.groupBy(subject).applyInArrow(run, f"{subject} {kind}, candidate int, f1 double")


SELECTED = "step int, added_feature string, cumulative_macro_f1 double, delta_f1 double, delta_f1_pct double, mode string"


def select_features(
    df: DataFrame, features: list[str], label: str, mode: str = "greedy", most: int = 20, least_pct: float = 0.0, pool: int | None = None, ranking: list[str] | None = None, subject: str = "subject_id"
) -> DataFrame:
    """The steps of a selection, from the baseline (the most frequent class) on: the mean over subjects of macro F1 with each left out.

    ``greedy`` adds what helps most at each step (ties: the first in rank), ``auc_rank`` what comes next in rank. Both end with the first step that gains less than ``least_pct`` per cent, after ``most`` steps,
    or when no feature is left. ``ranking``: the features, best first (default: by the largest separation of any class); ``pool``: how many of them may be chosen.
    """
    if mode not in ("greedy", "auc_rank"):
        raise ValueError(f"mode {mode}")
    counts = {r[label]: r["count"] for r in df.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}  # a row a class
    classes = sorted(counts)
    spark = df.sparkSession
    if not features or not classes:
        return spark.createDataFrame([], SELECTED)
    if ranking is None:
        order = auc_ranking(df, features, label, classes).groupBy("feature").agg(F.max("separation").alias("s")).collect()  # a row a feature
        ranking = [r["feature"] for r in sorted(order, key=lambda r: (-(r["s"] or 0), r["feature"]))]
    left = [f for f in dict.fromkeys(ranking) if f in features][:pool]
    if not left:
        return spark.createDataFrame([], SELECTED)
    top = max(classes, key=lambda c: (counts[c], -c))
    total = sum(counts.values())
    score = 2 * counts[top] / (counts[top] + total) / len(classes)
    steps = [(0, BASELINE, score, None, None, mode)]
    rows = written(scaled_rows(df, left, label, classes, subject), "scaled")
    every = moments(rows, len(left), len(classes))
    number = {f: k for k, f in enumerate(left)}
    chosen: list[str] = []
    for step in range(1, min(most, len(left)) + 1):
        tried = left[:1] if mode == "auc_rank" else left
        means = left_out_scores(rows, every, [[number[c] for c in (*chosen, f)] for f in tried], subject).groupBy("candidate").agg(F.avg("f1").alias("f1")).collect()  # a row a candidate
        if not means:
            break
        best = max(means, key=lambda r: (r["f1"], -r["candidate"]))
        f = tried[best["candidate"]]
        chosen.append(f)
        left = [x for x in left if x != f]
        delta = best["f1"] - score
        pct = delta / score * 100 if score > 0 else None
        steps.append((step, f, best["f1"], delta, pct, mode))
        score = best["f1"]
        if pct is not None and pct < least_pct:
            break
    return spark.createDataFrame(steps, SELECTED)
