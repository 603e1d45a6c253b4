"""Feature pipelines on Spark ML: classifiers, regression, projection, neighbours and clustering."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans, PowerIterationClustering
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, UnivariateFeatureSelector
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import testing

# functions that run in Python workers travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def with_vector(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


def forest_classifier(df: DataFrame, label: str, features: str = "features", trees: int = 100, folds: int = 5, seed: int = 42):
    """Scaled random forest: fitted model, its predictions and the cross-validated accuracy."""
    forest = RandomForestClassifier(featuresCol="_scaled", labelCol="_label", numTrees=trees, seed=seed)
    stages = [StringIndexer(inputCol=label, outputCol="_label"), StandardScaler(inputCol=features, outputCol="_scaled", withMean=True)]
    pipe = Pipeline(stages=[*stages, forest])
    judge = MulticlassClassificationEvaluator(labelCol="_label", metricName="accuracy")
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=ParamGridBuilder().build(), evaluator=judge, numFolds=folds, seed=seed).fit(df)
    return cv.bestModel, cv.bestModel.transform(df), cv.avgMetrics[0]


def forest_holdout(df: DataFrame, label: str, id: str, features: str = "features", trees: int = 100, test_percent: int = 20, seed: int = 42):
    """A scaled random forest fitted on most rows and judged on the others: model, predictions of the held-out rows, and figures.

    Rows are held out by a hash of ``id``, so the same ones in every run. The figures, one row, are ``n_train, n_test, accuracy``
    and, for two classes, ``auc`` (NULL otherwise); ``confusion`` and ``importances`` take the predictions and the model.
    """
    rows = cut_lineage(df.withColumn("_held", F.pmod(F.xxhash64(F.col(id).cast("string"), F.lit(seed)), F.lit(100)) < test_percent))
    train = rows.where("NOT _held")
    forest = RandomForestClassifier(featuresCol="_scaled", labelCol="_label", numTrees=trees, seed=seed)
    index = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep", stringOrderType="alphabetAsc")
    model = Pipeline(stages=[index, StandardScaler(inputCol=features, outputCol="_scaled", withMean=True), forest]).fit(train)
    predicted = cut_lineage(model.transform(rows.where("_held")).drop("_held"))
    classes = len(model.stages[0].labels)
    figures = accuracy(predicted).select(F.lit(train.count()).alias("n_train"), F.col("n").alias("n_test"), "accuracy")
    return model, predicted, figures.withColumn("auc", F.lit(binary_auc(predicted) if classes == 2 else None).cast("double"))


def linear_svm(df: DataFrame, label: str, features: str = "features", iterations: int = 50):
    """Scaled linear support vector machine, one against the rest for more than two classes."""
    svm = LinearSVC(featuresCol="_scaled", labelCol="_label", maxIter=iterations)
    classes = df.select(label).distinct().limit(3).count()
    last = svm if classes <= 2 else OneVsRest(classifier=svm, featuresCol="_scaled", labelCol="_label")
    pipe = Pipeline(stages=[StringIndexer(inputCol=label, outputCol="_label"), StandardScaler(inputCol=features, outputCol="_scaled", withMean=True), last])
    model = pipe.fit(df)
    return model, model.transform(df)


def forest_regressor(df: DataFrame, target: str, features: str = "features", trees: int = 100, seed: int = 42):
    model = RandomForestRegressor(featuresCol=features, labelCol=target, numTrees=trees, seed=seed).fit(df)
    return model, model.transform(df)


def regression_scores(predicted: DataFrame, target: str) -> DataFrame:
    """R squared and root mean square error in one aggregate."""
    y, p = F.col(target), F.col("prediction")
    return predicted.agg((1 - F.sum((y - p) ** 2) / (F.var_pop(y) * F.count(y))).alias("r2"), F.sqrt(F.avg((y - p) ** 2)).alias("rmse"))


def confusion(predicted: DataFrame, label: str = "_label") -> DataFrame:
    return predicted.groupBy(F.col(label).alias("label"), "prediction").agg(F.count(F.lit(1)).alias("n"))


def accuracy(predicted: DataFrame, label: str = "_label") -> DataFrame:
    return predicted.agg(F.avg((F.col(label) == F.col("prediction")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def importances(model, top: int = 20) -> DataFrame:
    """Feature numbers by falling importance; as many rows as features."""
    from pyspark.sql import SparkSession

    values = model.featureImportances.toArray().tolist()
    rows = SparkSession.active().createDataFrame([(i, float(v)) for i, v in enumerate(values)], "feature int, importance double")
    return rows.orderBy(F.desc("importance"), "feature").limit(top)


def select_features(df: DataFrame, label: str, n: int, features: str = "features") -> DataFrame:
    """Keep the ``n`` features of largest ANOVA F against a class label."""
    selector = UnivariateFeatureSelector(featuresCol=features, outputCol="selected", labelCol=label, selectionMode="numTopFeatures")
    return selector.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(n).fit(df).transform(df)


def principal_components(df: DataFrame, k: int = 2, features: str = "features") -> tuple[DataFrame, list[float]]:
    """Centred coordinates ``pc`` and the explained variance shares."""
    centre = StandardScaler(inputCol=features, outputCol="_centred", withMean=True, withStd=False).fit(df)
    model = PCA(k=k, inputCol="_centred", outputCol="pc").fit(centre.transform(df))
    return model.transform(centre.transform(df)).drop("_centred"), model.explainedVariance.toArray().tolist()


def feature_covariance(df: DataFrame, array: str) -> DataFrame:
    """Sample covariance (i, j, covariance) of each pair i <= j of positions of an array column.

    A task adds up products of rows less their means as one matrix, batch by batch, and gives each of its cells once. Rows where
    the array is null are left out; all arrays are of one length.
    """
    rows = df.where(F.col(array).isNotNull()).select(F.col(array).cast("array<double>").alias("v"))
    means = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))  # as many rows as positions
    centre = np.array([r["m"] for r in sorted(means.collect(), key=lambda r: r["i"])])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, gram = 0, np.zeros(len(centre)), np.zeros((len(centre), len(centre)))
        for batch in batches:
            x = np.array(batch["v"].tolist(), dtype=float).reshape(-1, len(centre)) - centre
            n, sums, gram = n + len(x), sums + x.sum(axis=0), gram + x.T @ x
        if n:
            i, j = np.triu_indices(len(centre))
            yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": n, "si": sums[i], "sj": sums[j], "sij": gram[i, j]})

    parts = rows.mapInPandas(products, "i int, j int, n long, si double, sj double, sij double")
    total = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")])
    return total.select("i", "j", F.when(F.col("n") > 1, (F.col("sij") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)).alias("covariance"))


def graph_clusters(edges: DataFrame, k: int, iterations: int = 20) -> DataFrame:
    """Power-iteration clusters of a neighbour graph, closer pairs weighing more."""
    w = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), (1 / (1 + F.col("distance"))).alias("weight")).distinct()
    # the clustering reads its edges more than once
    return PowerIterationClustering(k=k, maxIter=iterations, weightCol="weight").assignClusters(cut_lineage(w))


def kmeans(df: DataFrame, k: int, features: str = "features", seed: int = 42) -> DataFrame:
    return KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df).transform(df)


def binary_auc(predicted: DataFrame, label: str = "_label") -> float:
    """Area under ROC of the probability of class 1."""
    scored = predicted.withColumn("_score", vector_to_array("probability")[1])
    return testing.auc(scored, "_score", F.col(label) == 1).first()["auc"]


