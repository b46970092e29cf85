"""Boosted trees for several classes on binned inputs (survey T1, T3): gradient histograms are aggregates, trees of all folds and classes grow together.

*Binning.* Each feature has at most ``BINS`` bins (all values where they are few, else quantiles from a sketch); a missing value is a bin of its own. Binned rows are stored, a byte a feature.

*A round* grows one tree a class, for every fold's model at once, level by level. For one level each task goes over its rows, works out their gradients, and adds them
up by (model, class, node, feature, bin); Spark adds the tasks' sums up and finds each node's best split with a window over the bins. Only the chosen splits reach the driver: they are the model.

*Memory.* A task holds one level's histograms (``HISTOGRAM_BYTES`` at the most: beyond, features are dealt out to several passes) and the batch that it works on. Rows' scores are stored again every ``STORE_ROUNDS`` rounds, so
a pass applies a few trees to a row and not all of them.

Loss: softmax, one output a class; gain ``G_l^2/(H_l+l2) + G_r^2/(H_r+l2) - G^2/(H+l2)``; leaf ``-rate * G/(H+l2)``; a missing value goes to the side that gains more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.operators import decoders, stats
from nightgrid.sources.scratch import written

from .models import permuted, subject_folds

BINS, MISSING = 255, 255
HISTOGRAM_BYTES = 128 << 20
STORE_ROUNDS = 8
#: Hessian that a side of a split must have.
LEAST_HESSIAN = 1e-3


@dataclass
class Tree:
    """Nodes by number (children of ``i``: ``2i+1``, ``2i+2``): feature (-1: leaf), highest bin on the left, side of missing values, leaf value."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n))

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node that each row has come to."""
        at = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            go = np.flatnonzero(f >= 0)
            if not len(go):
                break
            here = at[go]
            b = x[go, f[go]]
            left = np.where(b == MISSING, self.missing_left[here], b <= self.cut[here])
            at[go] = 2 * here + 2 - left
        return at


@dataclass
class Boosted:
    """Models by fold: ``trees[round][model][class]``, the first scores, and how inputs are binned."""

    features: list[str]
    cuts: list[np.ndarray]
    classes: list[int]
    prior: np.ndarray  # models x classes
    weight: np.ndarray  # models x classes
    depth: int
    trees: list[list[list[Tree]]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Rows of values -> rows of bins."""
        out = np.empty(x.shape, np.uint8)
        for k, c in enumerate(self.cuts):
            out[:, k] = np.where(np.isnan(x[:, k]), MISSING, np.searchsorted(c, x[:, k], "left"))
        return out

    def scores(self, x: np.ndarray, model: int, start: np.ndarray | None = None, since: int = 0) -> np.ndarray:
        """Raw scores of binned rows by class."""
        out = np.tile(self.prior[model], (len(x), 1)) if start is None else start.copy()
        for trees in self.trees[since:]:
            for c, t in enumerate(trees[model]):
                out[:, c] += t.value[t.nodes(x)]
        return out


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def bin_cuts(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Per feature the highest value of each bin but the last: all values where there are ``bins`` at most, else quantiles."""
    clean = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    about = df.agg(*[F.approx_count_distinct(c).alias(f) for f, c in clean.items()]).first()
    few = [f for f in features if about[f] <= 1.2 * bins]  # the sketch is some 5 % off
    values = {}
    if few:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), clean[f].alias("v")) for k, f in enumerate(few)])).alias("x")).select("x.*")
        held = long.filter("v IS NOT NULL").distinct()
        sizes = held.groupBy("k").count().filter(F.col("count") <= bins).select("k")
        for r in held.join(F.broadcast(sizes), "k").groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("v")).collect():  # at most ``bins`` values a feature
            values[few[r["k"]]] = np.array(r["v"])
        for f in few:
            if about[f] == 0:
                values[f] = np.zeros(0)
    many = [f for f in features if f not in values]
    if many:
        q = df.agg(*[F.percentile_approx(clean[f], [i / bins for i in range(1, bins)], F.lit(10_000)).alias(f) for f in many]).first()
        values |= {f: np.unique(q[f]) if q[f] is not None else np.zeros(0) for f in many}
        return [values[f][:-1] if f not in many else values[f] for f in features]
    return [values[f][:-1] for f in features]


def _histograms(model: Boosted, level: int, grown: list[list[Tree]], since: int, group: list[int]):
    """Stored rows -> (model, class, node, feature, bin, g, h, n) of one task's rows at one level of the growing trees."""
    m_count, k_count, width = len(model.prior), len(model.classes), 2**level
    first, f_count = width - 1, len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = width * f_count * 256
        sums = np.zeros((m_count, k_count, 3, size))
        for b in batches:
            if not b.num_rows:
                continue
            fold, y = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            start = b.column(3).flatten().to_numpy().reshape(b.num_rows, m_count, k_count)
            place = np.arange(f_count) * 256 + x[:, group].astype(np.int64)
            for m in range(m_count):
                rows = np.flatnonzero(fold != m)
                weight = model.weight[m, y]
                p = softmax(model.scores(x[rows], m, start[rows, m], since))
                for c in range(k_count):
                    at = grown[m][c].nodes(x[rows]) - first
                    live = np.flatnonzero((at >= 0) & (at < width))
                    if not len(live):
                        continue
                    r, w = rows[live], weight[rows[live]]
                    g = w * (p[live, c] - (y[r] == c))
                    h = w * p[live, c] * (1 - p[live, c])
                    key = (at[live, None] * (f_count * 256) + place[r]).ravel()
                    for k, v in enumerate((g, h, np.ones(len(live)))):
                        sums[m, c, k] += np.bincount(key, weights=np.repeat(v, f_count), minlength=size)
        m, c, key = np.nonzero(sums[:, :, 2])
        g, h, n = (sums[m, c, k, key] for k in range(3))
        cols = [pa.array(v.astype(np.int32)) for v in (m, c, key // (f_count * 256) + first, np.array(group, np.int64)[key // 256 % f_count], key % 256)]
        yield pa.RecordBatch.from_arrays([*cols, *map(pa.array, (g, h, n.astype(np.int64)))], names=["model", "class", "node", "feature", "bin", "g", "h", "n"])

    return run


HISTOGRAM = "model int, class int, node int, feature int, bin int, g double, h double, n long"


def split_gains(histogram: DataFrame, least_rows: int, l2: float) -> DataFrame:
    """Every allowed split of a histogram: ``model, class, node, feature, cut, missing_left, gain`` and both sides' sums."""
    key = ["model", "class", "node", "feature"]
    upto = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*key)
    x = histogram
    for c in ("g", "h", "n"):
        x = x.withColumn(f"_{c}", F.sum(c).over(every)).withColumn(f"m_{c}", F.coalesce(F.sum(F.when(F.col("bin") == MISSING, F.col(c))).over(every), F.lit(0)))
        x = x.withColumn(f"l_{c}", F.sum(c).over(upto))
    x = x.filter(F.col("bin") != MISSING)
    both = None
    for left in (False, True):
        side = x.withColumn("missing_left", F.lit(left))
        for c in ("g", "h", "n"):
            a = F.col(f"l_{c}") + (F.col(f"m_{c}") if left else 0)
            side = side.withColumn(f"a_{c}", a).withColumn(f"b_{c}", F.col(f"_{c}") - a)
        side = side if not left else side.filter("m_n > 0")
        both = side if both is None else both.unionByName(side)
    part = lambda s: F.col(f"{s}g") * F.col(f"{s}g") / (F.col(f"{s}h") + l2)
    ok = (F.col("a_n") >= least_rows) & (F.col("b_n") >= least_rows) & (F.col("a_h") >= LEAST_HESSIAN) & (F.col("b_h") >= LEAST_HESSIAN)
    return both.filter(ok).select(*key, F.col("bin").alias("cut"), "missing_left", (part("a_") + part("b_") - part("_")).alias("gain"), "a_g", "a_h", "b_g", "b_h")


def best_splits(histogram: DataFrame, least_rows: int, l2: float) -> DataFrame:
    """The split of each node that gains most (ties: the first feature and cut), if any gains."""
    s = split_gains(histogram, least_rows, l2).filter("gain > 1e-12")
    one = F.max(F.struct(F.round("gain", 10).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("cut")).alias("c"), (~F.col("missing_left")).alias("right"), "a_g", "a_h", "b_g", "b_h")).alias("x")
    return s.groupBy("model", "class", "node").agg(one).select("model", "class", "node", "x.*")


def prepared(df: DataFrame, features: list[str], label: str, folds: int, depth: int, balanced: bool = True, seed: int = 7, subject: str = "subject_id") -> tuple[Boosted, DataFrame, DataFrame]:
    """A model without trees, its binned rows as a stored table, and ``subject, fold``."""
    n_models = max(folds, 1)
    held = subject_folds(df, label, folds, seed, subject) if folds else df.select(subject).distinct().withColumn("fold", F.lit(-1))
    known = df.filter(F.col(label).isNotNull())
    counts = known.join(held, subject).groupBy("fold", label).count().collect()  # folds x classes
    classes = sorted({r[label] for r in counts})
    n = np.array([[sum(r["count"] for r in counts if r[label] == c and r["fold"] != m) for c in classes] for m in range(n_models)], float)
    # each model's class weights: rows of all classes count the same
    weight = np.where(n > 0, n.sum(1, keepdims=True) / (len(classes) * np.maximum(n, 1)), 0.0) if balanced else np.ones_like(n)
    share = n * weight
    prior = np.log(np.maximum(share / np.maximum(share.sum(1, keepdims=True), 1e-300), 1e-15))
    model = Boosted(list(features), bin_cuts(known, features), classes, prior, weight, depth)
    code = {c: k for k, c in enumerate(classes)}
    kind = known.schema[label].dataType.simpleString()
    names = known.sparkSession.createDataFrame([(c, k) for c, k in code.items()], f"{label} {kind}, _y int")  # one row a class
    rows = known.join(F.broadcast(names), label).join(held, subject).select("fold", "_y", *[F.col(f).cast("double") for f in features])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(2 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(features))], 1) if features else np.zeros((b.num_rows, 0))
            first = pa.array(np.tile(prior.ravel(), b.num_rows))
            scores = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * prior.size, first)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in model.binned(x)], pa.binary()), scores], names=["fold", "y", "bins", "scores"])

    stored = written(rows.mapInArrow(binned, "fold int, y int, bins binary, scores array<double>"), "binned")
    return model, stored, held


def root_gains(df: DataFrame, features: list[str], label: str, least_rows: int = 20, l2: float = 0.0, balanced: bool = False, subject: str = "subject_id") -> DataFrame:
    """All splits of a first tree's root and what they gain: ``class, feature, cut`` (the highest value on the left), ``missing_left``, ``gain``."""
    model, stored, _ = prepared(df, features, label, 0, 1, balanced, subject=subject)
    tree = [[Tree.empty(1) for _ in model.classes]]
    h = stored.mapInArrow(_histograms(model, 0, tree, 0, list(range(len(features)))), HISTOGRAM).groupBy("model", "class", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
    cuts = F.array(*[F.array(*[F.lit(float(v)) for v in c]).cast("array<double>") for c in model.cuts])
    names = F.array(*[F.lit(f) for f in features])
    return split_gains(h, least_rows, l2).select(F.get(F.array(*[F.lit(c) for c in model.classes]), F.col("class")).alias("class"), F.get(names, F.col("feature")).alias("feature"), F.get(F.get(cuts, F.col("feature")), F.col("cut")).alias("cut"), "missing_left", "gain")


def fit(
    df: DataFrame, features: list[str], label: str, folds: int = 0, rounds: int = 100, depth: int = 5, rate: float = 0.1, least_rows: int = 20, l2: float = 0.0, balanced: bool = True, seed: int = 7, subject: str = "subject_id"
) -> tuple[Boosted, DataFrame]:
    """One model on all rows (``folds`` 0), or one for each fold of subjects, that has not seen them; and ``subject, fold``."""
    model, stored, held = prepared(df, features, label, folds, depth, balanced, seed, subject)
    n_models, classes = len(model.prior), model.classes
    per_feature = n_models * len(classes) * 2 ** (depth - 1) * 256 * 24
    group = max(1, HISTOGRAM_BYTES // per_feature)
    groups = [list(range(i, min(i + group, len(features)))) for i in range(0, len(features), group)]
    since = 0
    for done in range(1, rounds + 1):
        grown = [[Tree.empty(depth) for _ in classes] for _ in range(n_models)]
        for level in range(depth):
            histogram = None
            for g in groups:
                part = stored.mapInArrow(_histograms(model, level, grown, since, g), HISTOGRAM)
                histogram = part if histogram is None else histogram.unionByName(part)
            histogram = histogram.groupBy("model", "class", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
            chosen = best_splits(histogram, least_rows, l2).collect()  # one row a node that splits
            for r in chosen:
                t, i = grown[r["model"]][r["class"]], r["node"]
                t.feature[i], t.cut[i], t.missing_left[i] = -r["f"], -r["c"], not r["right"]
                for child, side in ((2 * i + 1, "a"), (2 * i + 2, "b")):
                    t.value[child] = -rate * r[f"{side}_g"] / (r[f"{side}_h"] + l2)
            if not chosen:
                break
        model.trees.append(grown)
        if done % STORE_ROUNDS == 0 and done < rounds:
            stored, since = written(stored.mapInArrow(_advanced(model, since), stored.schema), "scores"), done
    return model, held


def _advanced(model: Boosted, since: int):
    """Stored rows with the scores after the rounds that they lack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            start = b.column(3).flatten().to_numpy().reshape(b.num_rows, *model.prior.shape)
            now = np.stack([model.scores(x, m, start[:, m], since) for m in range(len(model.prior))], 1)
            scores = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * model.prior.size, pa.array(now.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], scores], names=["fold", "y", "bins", "scores"])

    return run


def predict(model: Boosted, df: DataFrame, keys: list[str], fold: str | None = None) -> DataFrame:
    """``keys``, ``y_pred`` and ``proba`` (by class, in order) of each row; with ``fold``, by the model that has not seen that fold."""
    of = F.col(fold).cast("int") if fold else F.lit(0)
    src = df.select(*keys, of.alias("_model"), *[F.col(f).cast("double").alias(f"_x{k}") for k, f in enumerate(model.features)])
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)
    names = [*keys, "y_pred", "proba"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k = b.num_rows, len(keys)
            who = b.column(k).to_numpy(zero_copy_only=False)
            x = np.stack([b.column(k + 1 + j).to_numpy(zero_copy_only=False).astype(float) for j in range(len(model.features))], 1)
            bins, p = model.binned(x), np.zeros((n, len(model.classes)))
            for m in np.unique(who):
                p[who == m] = softmax(model.scores(bins[who == m], int(m)))
            best = np.array(model.classes)[p.argmax(1)] if n else np.zeros(0)
            proba = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * p.shape[1], pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(best.astype(np.int32)), proba], names=names)

    return src.mapInArrow(run, f"{kinds}, y_pred int, proba array<double>")


def out_of_fold(df: DataFrame, features: list[str], label: str, k: int = 5, subject: str = "subject_id", keys: list[str] | None = None, **options) -> DataFrame:
    """V2 with boosted trees: every row by the model that has not seen its subject."""
    model, held = fit(df, features, label, folds=k, subject=subject, **options)
    keys = [*(keys or [c for c in df.columns if c not in features]), "fold"]
    return predict(model, df.join(held, subject), keys, "fold")


def permutation_importance(df: DataFrame, groups: dict[str, list[str]], label: str, k: int = 5, seed: int = 7, subject: str = "subject_id", **options) -> list[tuple[str, float]]:
    """What macro F1 loses when a group of columns (a signal at all times, or all signals at one time) is dealt anew among rows, by held-out models; largest first."""
    features = list(dict.fromkeys(f for g in groups.values() for f in g))
    model, held = fit(df, features, label, folds=k, seed=seed, subject=subject, **options)
    rows = written(df.join(held, subject).select("fold", label, *features), "importance")

    def score(x: DataFrame) -> float:
        p = predict(model, x, ["fold", label], "fold").filter(F.col(label).isNotNull())
        return stats.summary(p, label, "y_pred", model.classes).first()["macro_f1"]

    base = score(rows)
    return sorted(((name, base - score(permuted(rows, cols, seed))) for name, cols in groups.items()), key=lambda r: (-r[1], r[0]))


def window_frame(rows: DataFrame, epochs: DataFrame, signals: list[str], context: int = 2, per_epoch: int = 5, slot: str = "slot", subject: str = "subject_id") -> tuple[DataFrame, list[str]]:
    """For each labelled epoch the rows of its window (``context`` epochs on either side) as columns ``signal__step``, step 0 at the epoch's first row.

    Steps beyond the night, or without a value, are missing; trees need no scale, so values stay as they are. One window over a subject's rows, no join of rows with rows.
    """
    w = Window.partitionBy(subject).orderBy(slot)
    steps = range(-context * per_epoch, (context + 1) * per_epoch)
    names = [f"{s}__{t:+d}" for t in steps for s in signals]
    near = lambda c, t: F.lag(c, -t).over(w) if t < 0 else F.lead(c, t).over(w)
    at = [F.when(near(slot, t) == F.col(slot) + t, near(s, t)).alias(f"{s}__{t:+d}") for t in steps for s in signals]
    x = rows.select(subject, slot, *at).filter(F.col(slot) % per_epoch == 0).withColumn("epoch_index", (F.col(slot) / per_epoch).cast("long")).drop(slot)
    return epochs.join(x, [subject, "epoch_index"]), names


def window_model(rows: DataFrame, epochs: DataFrame, signals: list[str], label: str, k: int = 5, context: int = 2, subject: str = "subject_id", seed: int = 7, **options) -> DataFrame:
    """Held-out probabilities of boosted trees on windows, and the night's stages after smoothing with the transitions of the subjects that the model has seen.

    Gives ``subject, epoch_index, label, fold, y_pred, proba, smoothed, decoded``; classes are 0, 1, .. in order.
    """
    frame, names = window_frame(rows, epochs.select(subject, "epoch_index", label), signals, context, subject=subject)
    frame = written(frame, "windows")
    model, held = fit(frame, names, label, folds=k, seed=seed, subject=subject, **options)
    pred = written(predict(model, frame.join(held, subject), [subject, "epoch_index", label, "fold"], "fold"), "held_out")
    n, out = len(model.classes), None
    state = pred.withColumn("_state", F.array_position(F.array(*[F.lit(c) for c in model.classes]), F.col(label)).cast("int") - 1)
    for f in range(k):
        seen = state.filter(F.col("fold") != f)
        trans = decoders.matrix(decoders.transition_counts(seen, "_state", "epoch_index", n, (subject,)), n)
        initial = [r["p"] for r in decoders.initial_shares(seen, "_state", "epoch_index", n, (subject,)).orderBy("state").collect()]  # a row a class
        part = decoders.smooth_nights(pred.filter(F.col("fold") == f), "epoch_index", "proba", trans, np.array(initial), subject)
        out = part if out is None else out.unionByName(part)
    stages = F.get(F.array(*[F.lit(c) for c in model.classes]), F.col("decoded"))
    return pred.join(out.select(subject, "epoch_index", "smoothed", stages.alias("decoded")), [subject, "epoch_index"])
