"""Learners from MLlib or short aggregations, and point processes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def logistic_gd(df: DataFrame, features: list[str], label: str, steps: int = 200, rate: float = 0.5, ridge: float = 0.01) -> list[float]:
    """Weights (intercept last) of a logistic regression by gradient descent; each step is one aggregation, of which only sums reach the driver."""
    stats = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop))], F.count("*").alias("n")).first()
    scaled = df.select(*[((F.col(c) - stats[f"m{i}"]) / (stats[f"s{i}"] or 1.0)).alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y")).cache()
    w = [0.0] * (len(features) + 1)
    xs = [F.col(f"x{i}") for i in range(len(features))]
    for _ in range(steps):
        z = sum((x * v for x, v in zip(xs, w, strict=False)), F.lit(w[-1]))
        r = 1 / (1 + F.exp(-z)) - F.col("y")
        g = scaled.agg(*[F.avg(r * x).alias(f"g{i}") for i, x in enumerate(xs)], F.avg(r).alias("b")).first()
        w = [v - rate * (g[f"g{i}"] + ridge * v) for i, v in enumerate(w[:-1])] + [w[-1] - rate * g["b"]]
    scaled.unpersist()
    return w


def ridge_r2(df: DataFrame, features: list[str], target: str, penalties: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), folds: int = 3) -> tuple[float, float]:
    """(R2 on the last 30 % of rows by target, penalty): medians for missing values, standard scales, and a ridge whose penalty cross-validation chooses."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    filled = [f"{c}_filled" for c in features]
    line = LinearRegression(labelCol=target, elasticNetParam=0.0)
    stages = [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    judge = RegressionEvaluator(labelCol=target, metricName="r2")
    search = CrossValidator(estimator=line, estimatorParamMaps=ParamGridBuilder().addGrid(line.regParam, list(penalties)).build(), evaluator=judge, numFolds=folds, seed=7)
    cut = df.agg(F.percentile(target, F.lit(0.7)).alias("c")).first()["c"]
    model = Pipeline(stages=[*stages, search]).fit(df.where(F.col(target) <= cut))
    return judge.evaluate(model.transform(df.where(F.col(target) > cut))), model.stages[-1].bestModel.getRegParam()


def simplex(f, start: list[float], scale: float = 0.2, rounds: int = 80) -> list[float]:
    """Nelder-Mead minimum of a function of a few parameters; each call may be an aggregation."""
    pts = [(f(p), p) for p in [list(start), *[[v + (scale if i == k else 0) for i, v in enumerate(start)] for k in range(len(start))]]]
    for _ in range(rounds):
        pts.sort(key=lambda q: q[0])
        mid = np.mean([p for _, p in pts[:-1]], axis=0)
        worst = np.array(pts[-1][1])
        move = lambda k: (f(q := list(mid + k * (mid - worst))), q)
        r = move(1.0)
        if r[0] < pts[0][0]:
            pts[-1] = min(r, move(2.0), key=lambda q: q[0])
        elif r[0] < pts[-2][0]:
            pts[-1] = r
        elif (c := move(-0.5))[0] < pts[-1][0]:
            pts[-1] = c
        else:
            best = np.array(pts[0][1])
            pts = [pts[0], *[(f(q := list(best + 0.5 * (np.array(p) - best))), q) for _, p in pts[1:]]]
    return min(pts, key=lambda q: q[0])[1]


def rate_ll(mu: Column, a: Column, span: float, kernel: str = "k") -> Column:
    """Log-likelihood of a background rate and a productivity: an aggregate over each event's sum of kernels."""
    return F.sum(F.log(mu + a * F.col(kernel))) - mu * span * F.count("*") - a * F.sum(kernel)


def fit_rates(rates: DataFrame, span: float, start: tuple[float, float] = (0.001, 0.01), rounds: int = 60) -> tuple[float, float, float]:
    """(mu, a, log-likelihood) of the greatest likelihood; each step is one aggregation, of which one number reaches the driver."""
    held = rates.cache()

    def loss(p: list[float]) -> float:
        mu, a = (math.exp(min(float(v), 50.0)) for v in p)
        ll = held.agg(rate_ll(F.lit(mu), F.lit(a), span).alias("ll")).first()["ll"]
        return math.inf if ll is None or math.isnan(ll) else -ll

    best = simplex(loss, [math.log(v) for v in start], rounds=rounds)
    out = (*(math.exp(float(v)) for v in best), -loss(best))
    held.unpersist()
    return out


def centroid_splits(df: DataFrame, key: str, vector: str, label: str, splits: int) -> DataFrame:
    """(split, n, accuracy): the nearest class centroid on the 30 % of rows that each split holds out; ties to the least label.

    Keys are unique. Centroids, a row a split, go to the vectors, which are shuffled once at most, and only as they are: what else moves is a partial mean a task, class and component.
    """
    v = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("x"))
    tasks = 3 * df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < tasks:  # few vectors are much work
        v = v.repartition(tasks, "id")
    v = v.withColumn("x", F.col("x").cast("array<double>"))
    out = lambda s: F.pmod(F.pmod(F.col("id") * 7919 + s * 104729, F.lit(100003)), F.lit(10)) < 3
    every = F.sequence(F.lit(1), F.lit(splits))
    parts = v.select("label", F.transform(every, out).alias("out"), F.posexplode("x").alias("i", "x"))
    mean = parts.groupBy("label", "i").agg(*[F.avg(F.when(~F.col("out")[s - 1], F.col("x"))).alias(f"m{s}") for s in range(1, splits + 1)])
    mean = mean.select("label", "i", F.posexplode(F.array(*[f"m{s}" for s in range(1, splits + 1)])).alias("split", "mu")).where("mu is not null").withColumn("split", F.col("split") + 1)
    mid = mean.groupBy("split", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mu"))), lambda t: t["mu"]).alias("mu"))
    mids = mid.groupBy("split").agg(F.collect_list(F.struct(F.col("label").alias("said"), "mu")).alias("mids"))  # a row a split
    far = lambda mu: F.round(F.aggregate(F.zip_with("x", mu, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d), 9)
    held = v.withColumn("split", F.explode(F.filter(every, out))).join(F.broadcast(mids), "split")
    near = held.select("split", "label", F.array_min(F.transform("mids", lambda m: F.struct(far(m["mu"]).alias("d"), m["said"].alias("said")))).alias("near"))
    return near.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg((F.col("near.said") == F.col("label")).cast("int")), 9).alias("accuracy"))


def forest_classes(train: DataFrame, test: DataFrame, vector: str, label: str, trees: int = 20) -> DataFrame:
    """test with said: the class that most trees of a forest from MLlib vote for."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    mark = lambda d: d.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    model = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=6, seed=7).fit(mark(train).select("features", label))
    return model.transform(mark(test)).withColumn("said", F.col("prediction").cast("int")).select(*test.columns, "said")


def network_scores(train: DataFrame, test: DataFrame, features: list[str], label: str, hidden: int = 8, iterations: int = 30) -> DataFrame:
    """test with score: a feed-forward network from MLlib over standardised features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    net = MultilayerPerceptronClassifier(labelCol=label, layers=[len(features), hidden, 2], maxIter=iterations, seed=7)
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), net]).fit(train)
    return model.transform(test).withColumn("score", vector_to_array("probability")[1]).select(*test.columns, "score")
