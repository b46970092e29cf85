"""Experiments over grouped folds: stage fit, feature selection, importance, complexity, smoothers, drop-column, votes.

The loops over folds and candidates are on the driver; every fit and score runs on the cluster.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.operators import stats
from nightgrid.operators.selectors import family

from .models import cross_validated, estimator, permuted, subject_folds, with_class_weights


def stage_fit(df: DataFrame, features: list[str], label: str, stage: int) -> float:
    """AUC of one stage against the rest, by a balanced logistic model with degree-2 terms."""
    x = with_class_weights(df.withColumn("y", (F.col(label) == stage).cast("double")), "y")
    imputed = [f + "__imp" for f in features]
    model = Pipeline(stages=[
        Imputer(strategy="median", inputCols=features, outputCols=imputed), VectorAssembler(inputCols=imputed, outputCol="_a"), StandardScaler(inputCol="_a", outputCol="_b", withMean=True),
        PolynomialExpansion(degree=2, inputCol="_b", outputCol="_c"), LogisticRegression(featuresCol="_c", labelCol="y", weightCol="weight", maxIter=40, regParam=1e-3),
    ]).fit(x)
    return BinaryClassificationEvaluator(labelCol="y").evaluate(model.transform(x))


def macro_f1(pred: DataFrame, label: str, labels: list[int]) -> float:
    return stats.summary(pred, label, "y_pred", labels).collect()[0]["macro_f1"]


def greedy_selection(df: DataFrame, features: list[str], label: str, labels: list[int], most: int = 5, least_gain: float = 0.002, k: int = 3) -> list[tuple[str, float]]:
    """Adds the feature that helps out-of-fold macro F1 most, until the gain is too small."""
    chosen, score = [], 0.0
    while len(chosen) < min(most, len(features)):
        tried = [(macro_f1(cross_validated(df, [*[c for c, _ in chosen], f], label, k=k), label, labels), f) for f in features if f not in [c for c, _ in chosen]]
        best, name = max(tried)
        if chosen and best - score < least_gain:
            break
        chosen.append((name, best))
        score = best
    return chosen


def auc_ranking(df: DataFrame, features: list[str], label: str, labels: list[int]) -> DataFrame:
    """Separation of every class by every feature, max(auc, 1 - auc), from one unpivoted scan."""
    long = df.select(label, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("e")).select(label, "e.*")
    per = long.select("feature", "x", F.explode(F.array(*[F.struct(F.lit(c).alias("class"), (F.col(label) == c).cast("int").alias("y")) for c in labels])).alias("e")).select("feature", "x", "e.*")
    auc = stats.rank_auc(per, "x", "y", ("feature", "class")).withColumn("separation", F.greatest("auc", 1 - F.col("auc")))
    d = per.groupBy("feature", "class").agg(stats.cohens_d(F.col("x"), F.col("y") == 1).alias("d"))
    out = auc.join(d, ["feature", "class"])
    w = Window.partitionBy("class").orderBy(F.desc("separation"), "feature")
    return out.withColumn("rank", F.row_number().over(w)).select("feature", "class", "separation", "d", "rank")


def permutation_importance(df: DataFrame, features: list[str], label: str, labels: list[int], model, seed: int = 7) -> list[tuple[str, float]]:
    """T4: loss of macro F1 when a feature is dealt anew; ``model`` transforms a frame to ``prediction``."""
    score = lambda x: macro_f1(model.transform(x).withColumn("y_pred", F.col("prediction").cast("int")), label, labels)
    base = score(df)
    return sorted(((f, base - score(permuted(df, f, seed))) for f in features), key=lambda r: -r[1])


def family_importance(rows: list[tuple[str, float]]) -> dict[str, float]:
    """Importances added up by generator."""
    out: dict[str, float] = {}
    for name, v in rows:
        out[family(name)] = out.get(family(name), 0.0) + v
    return out


def complexity_sweep(df: DataFrame, features: list[str], label: str, labels: list[int], depths: tuple[int, ...] = (2, 4, 6, 8), k: int = 5) -> list[tuple[int, int, float]]:
    """T5: (depth, learned values, macro F1) of trees: values of one fitted on all rows, score out of fold over subject groups."""
    out = []
    x = with_class_weights(df.withColumn(label, F.col(label).cast("double")), label)
    for d in depths:
        size = estimator("tree", features, label, "weight", depth=d).fit(x).stages[-1].numNodes
        out.append((d, size, macro_f1(cross_validated(df, features, label, "tree", k=k, depth=d), label, labels)))
    return out


def drop_column(df: DataFrame, features: list[str], label: str, labels: list[int], k: int = 3) -> list[tuple[str, float]]:
    """Change of out-of-fold macro F1 when one feature is left out."""
    base = macro_f1(cross_validated(df, features, label, k=k), label, labels)
    return [(f, macro_f1(cross_validated(df, [x for x in features if x != f], label, k=k), label, labels) - base) for f in features]


def probability_context(pred: DataFrame, order: str, n_classes: int, radius: int = 2, key: str = "subject_id") -> tuple[DataFrame, list[str]]:
    """CW7, CW8, F51: neighbours' probabilities, logits and confidence beside each row; and the new names."""
    w = Window.partitionBy(key).orderBy(order)
    cols = {}
    for n in range(-radius, radius + 1):
        for c in range(n_classes):
            p = F.lag(F.get("proba", F.lit(c)), -n).over(w)
            cols[f"p{c}_{n + radius}"] = p
            q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
            cols[f"l{c}_{n + radius}"] = F.ln(q / (1 - q))
    ranked = F.sort_array("proba", asc=False)
    cols |= {"top1": F.get(ranked, F.lit(0)), "margin": F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1)), "entropy": -F.aggregate("proba", F.lit(0.0), lambda a, p: a + p * F.ln(F.greatest(p, F.lit(1e-12))))}
    return pred.withColumns(cols), list(cols)


def second_stage(pred: DataFrame, order: str, label: str, n_classes: int, radius: int = 2, k: int = 3) -> DataFrame:
    """A linear model on the neighbourhood of out-of-fold probabilities, validated on subject groups again."""
    x, names = probability_context(pred.drop("fold", "y_pred"), order, n_classes, radius)
    return cross_validated(x, names, label, k=k)


def vote(experts: list[str]) -> "F.Column":
    """The class whose normalised expert score is highest; the first of equal ones."""
    total = sum((F.coalesce(F.col(e), F.lit(0.0)) for e in experts[1:]), F.coalesce(F.col(experts[0]), F.lit(0.0)))
    share = F.array(*[F.coalesce(F.try_divide(F.coalesce(F.col(e), F.lit(0.0)), total), F.lit(0.0)) for e in experts])
    return (F.array_position(share, F.array_max(share)) - 1).cast("int")


def one_vs_rest(df: DataFrame, features: list[str], label: str, labels: list[int], k: int = 3, seed: int = 7) -> DataFrame:
    """One expert per class, each row scored by experts that did not see its subject; a class with a single value in training gets its constant probability."""
    x = df.join(subject_folds(df, label, k, seed), "subject_id").persist()
    shares = {r["fold"]: r for r in x.withColumn("fold", F.explode(F.filter(F.array(*map(F.lit, range(k))), lambda f: f != F.col("fold")))).groupBy("fold").agg(*[F.avg((F.col(label) == c).cast("double")).alias(f"c{c}") for c in labels]).collect()}
    done = None
    for f in range(k):
        train, part = x.filter(F.col("fold") != f), x.filter(F.col("fold") == f)
        for c in labels:
            y = train.withColumn("_y", (F.col(label) == c).cast("double"))
            share = shares[f][f"c{c}"] if f in shares else None
            if share in (None, 0.0, 1.0):
                part = part.withColumn(f"expert_{c}", F.lit(float(share or 0.0)))
                continue
            imputed = [n + "__imp" for n in features]
            m = Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=imputed), VectorAssembler(inputCols=imputed, outputCol="_v"), LogisticRegression(featuresCol="_v", labelCol="_y", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_q", maxIter=30)]).fit(y)
            part = m.transform(part).withColumn(f"expert_{c}", F.get(vector_to_array("_p"), F.lit(1))).drop("_v", "_p", "_r", "_q", *imputed)
        done = part if done is None else done.unionByName(part)
    x.unpersist()
    return done


class Ledger:
    """A held-out set is scored once; the table of looks refuses a second one for the same name."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def looks(self) -> list[str]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return []
        return [r["name"] for r in self.spark.read.parquet(self.path).select("name").collect()]

    def score_once(self, name: str, pred: DataFrame, label: str, labels: list[int], dev_subjects: DataFrame) -> DataFrame:
        if name in self.looks():
            raise PermissionError(f"{name} was scored before")
        if not pred.join(dev_subjects, "subject_id", "left_semi").isEmpty():
            raise ValueError("held-out subjects are among those that the model was fit on")
        out = stats.summary(pred, label, "y_pred", labels).withColumn("name", F.lit(name))
        out.write.mode("append").parquet(self.path)
        return out
