"""Subject-grouped validation with MLlib models (survey 2.10)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.operators import stats
from nightgrid.operators.numbering import numbered


def subject_folds(df: DataFrame, label: str, k: int = 5, seed: int = 7, subject: str = "subject_id") -> DataFrame:
    """V1: ``subject, fold``. Subjects are lined up by the class of which they hold the largest share, by size and by a seeded hash, and dealt back and
    forth over the folds, so each fold has its part of every class and size.

    The line is a distributed order of one row a subject; nothing of it reaches the driver.
    """
    n = df.groupBy(subject, label).agg(F.count("*").alias("_n"))
    n = n.withColumnRenamed(label, "_class")
    every = n.groupBy(F.col("_class").alias("_c")).agg(F.sum("_n").alias("_all"))  # one row a class
    share = n.join(F.broadcast(every), F.equal_null("_class", "_c")).withColumn("_share", F.col("_n") / F.col("_all"))
    line = share.groupBy(subject).agg(F.sum("_n").alias("_size"), F.max_by("_class", F.struct("_share", "_class")).alias("_class"))
    line = line.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(seed), F.col(subject).cast("string"))))
    line = numbered(line, F.col("_class").asc_nulls_last(), F.col("_size").desc(), F.col("_hash"), F.col(subject), name="_i")
    place = F.col("_i") % (2 * k)
    return line.select(subject, F.when(place < k, place).otherwise(2 * k - 1 - place).cast("int").alias("fold"))


def estimator(family: str, features: list[str], label: str, weight: str | None = None, seed: int = 7, classes: int | None = None, depth: int = 8) -> Pipeline:
    """Linear, tree, ensemble (bagged trees), random_forest or mlp, with imputed and (linear, mlp) scaled inputs."""
    imputed = [f"{f}__imp" for f in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=imputed), VectorAssembler(inputCols=imputed, outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)]
    extra = {"weightCol": weight} if weight else {}
    model = {
        "linear": lambda: LogisticRegression(featuresCol="_x", labelCol=label, maxIter=50, regParam=1e-3, **extra),
        "tree": lambda: DecisionTreeClassifier(featuresCol="_raw", labelCol=label, maxDepth=depth, seed=seed, **extra),
        "ensemble": lambda: RandomForestClassifier(featuresCol="_raw", labelCol=label, numTrees=60, maxDepth=5, featureSubsetStrategy="all", seed=seed, **extra),
        "random_forest": lambda: RandomForestClassifier(featuresCol="_raw", labelCol=label, numTrees=60, maxDepth=10, seed=seed, **extra),
        "mlp": lambda: MultilayerPerceptronClassifier(featuresCol="_x", labelCol=label, layers=[len(features), 16, classes or 2], seed=seed),
    }[family]()
    return Pipeline(stages=[*stages, model])


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    """Total / (classes * count)."""
    c = df.groupBy(label).agg(F.count("*").alias("_n"))
    one = Window.partitionBy()  # one row per class
    c = c.withColumn("weight", F.sum("_n").over(one) / (F.count("*").over(one) * F.col("_n").cast("double"))).drop("_n")
    return df.join(F.broadcast(c), label)  # one row per class


def cross_validated(df: DataFrame, features: list[str], label: str, family: str = "linear", k: int = 5, seed: int = 7, balanced: bool = True, subject: str = "subject_id", depth: int = 8) -> DataFrame:
    """Out-of-fold predictions; no row is scored by a model that saw its subject."""
    folds = subject_folds(df, label, k, seed, subject)
    x = df.join(folds, subject).withColumn(label, F.col(label).cast("double")).persist()
    out = None
    for f in range(k):
        train, test = x.filter(F.col("fold") != f), x.filter(F.col("fold") == f)
        fit = estimator(family, features, label, "weight" if balanced and family != "mlp" else None, seed, depth=depth).fit(with_class_weights(train, label) if balanced else train)
        p = fit.transform(test).select(*df.columns, "fold", F.col("prediction").cast("int").alias("y_pred"), vector_to_array("probability").alias("proba"))
        out = p if out is None else out.unionByName(p)
    x.unpersist()  # the predictions are worked out from the table again
    return out.withColumn(label, F.col(label).cast("int"))


def inner_validation(subjects: DataFrame, fold: int, n: int = 1, seed: int = 7, subject: str = "subject_id") -> DataFrame:
    """``subject, validation``: ``n`` subjects in name order, from a place that moves on with the fold and the seed (counted from 1)."""
    x = subjects.select(F.col(subject)).distinct()
    total = x.count()
    if not 0 < n < total:
        raise ValueError("not enough subjects to validate on")
    place = F.row_number().over(Window.orderBy(F.col(subject).cast("string"))) - 1  # one row a subject
    return x.withColumn("validation", F.pmod(place - F.lit((fold - 1 + seed) % total), F.lit(total)) < n)


def fold_scores(pred: DataFrame, label: str, labels: list[int]) -> DataFrame:
    """Accuracy, macro F1 and kappa per fold."""
    return stats.summary(pred, label, "y_pred", labels, ("fold",))


def permuted(df: DataFrame, column: str | list[str], seed: int = 7) -> DataFrame:
    """T4: ``column`` (or several together) dealt anew among rows: each row takes the values of the row at the same place of a seeded order.

    Both orders are stored with their numbers before they are joined, so no value is lost or doubled.
    """
    keyed = df.withColumn("_tie", F.xxhash64(*df.columns)).withColumn("_r", F.xxhash64("_tie", F.lit(seed)))
    columns = [column] if isinstance(column, str) else list(column)
    a = numbered(keyed.drop("_r", *columns), "_tie", name="_n")
    b = numbered(keyed.select("_tie", "_r", *columns), "_r", "_tie", name="_n").select("_n", *columns)
    return a.join(b, "_n").select(df.columns)
