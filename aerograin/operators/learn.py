"""Forecast models on the hourly features, by Spark's own learners, and the fault study on row windows."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGRESSORS = {
    "ridge": lambda: LinearRegression(featuresCol="x", labelCol="y", regParam=1.0, elasticNetParam=0.0),
    "tree": lambda: DecisionTreeRegressor(featuresCol="x", labelCol="y", maxDepth=6, seed=1),
    "forest": lambda: RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=20, maxDepth=6, seed=1),
    "boosted": lambda: GBTRegressor(featuresCol="x", labelCol="y", maxIter=10, maxDepth=4, seed=1),
}
CLASSIFIERS = {
    "logistic": lambda: LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=0.01),
    "tree": lambda: DecisionTreeClassifier(featuresCol="x", labelCol="y", weightCol="w", maxDepth=6, seed=1),
    "forest": lambda: RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="w", numTrees=20, maxDepth=6, seed=1),
}


def perceptron(inputs: int) -> MultilayerPerceptronClassifier:
    """One hidden layer; takes no row weights."""
    return MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[inputs, 12, 2], maxIter=30, seed=1)


def tune(train: DataFrame, cols: list[str], grid: list[tuple[str, object]], folds: list[tuple[Column, Column]]) -> DataFrame:
    """params, place, cv_mae, chosen: the mean error of each learner of the grid over the folds (conditions on rows of `train`
    for fitting and validating). Equal errors go to the first of the grid. One small row a learner comes to the driver."""
    rows = []
    for place, (name, learner) in enumerate(grid):
        errors = []
        for fit_on, check_on in folds:
            e = assembled(cols, learner).fit(train.where(fit_on)).transform(train.where(check_on))
            errors.append(e.agg(F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("e")).first()["e"])
        known = [x for x in errors if x is not None]
        rows.append((name, place, sum(known) / len(known) if known else None))
    best = min((r for r in rows if r[2] is not None), key=lambda r: (round(r[2], 10), r[1]), default=None)
    return train.sparkSession.createDataFrame([(*r, best is not None and r[1] == best[1]) for r in rows], "params string, place int, cv_mae double, chosen boolean")


def assembled(cols: list[str], learner) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), learner])


def regress(train: DataFrame, test: DataFrame, cols: list[str], which: dict | None = None) -> DataFrame:
    """model, n, mae, rmse on test rows (label y); the models are fitted one after another, each in parallel."""
    out = None
    for name, make in (which or REGRESSORS).items():
        e = assembled(cols, make()).fit(train).transform(test).withColumn("e", F.col("y") - F.col("prediction"))
        m = e.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))
        out = m if out is None else out.unionByName(m)
    return out


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """w: rows over (classes times rows of the class)."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_k"))
    whole = per.agg(F.sum("_k").alias("_n"), F.count(F.lit(1)).alias("_c"))
    return df.join(F.broadcast(per.crossJoin(whole).select(label, (F.col("_n") / (F.col("_c") * F.col("_k"))).alias("w"))), label)  # a row a class


def classify(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    """model, n, accuracy, tp, fp, fn of class 1 on test rows."""
    weighted, out = class_weights(train), None
    for name, make in (CLASSIFIERS | {"perceptron": lambda: perceptron(len(cols))}).items():
        e = assembled(cols, make()).fit(weighted).transform(test)
        hit = lambda a, b: F.count_if((F.col("y") == a) & (F.col("prediction") == b))
        m = e.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == F.col("prediction")).cast("int")).alias("accuracy"), hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"))
        out = m if out is None else out.unionByName(m)
    return out


def importance(model, test: DataFrame, cols: list[str]) -> DataFrame:
    """feature, increase of the error when that column's values change rows (dealt by hash within the test set)."""
    err = lambda d: model.transform(d).agg(F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("e"))
    base = err(test).select(F.col("e").alias("base"))
    order = lambda k: F.row_number().over(Window.partitionBy(F.col("home")).orderBy(k, "time"))
    out = None
    for c in cols:
        a = test.withColumn("_i", order(F.col("time")))
        b = test.withColumn("_i", order(F.xxhash64(F.lit(c), "home", "time"))).select("home", "_i", F.col(c).alias("_v"))
        m = err(a.join(b, ["home", "_i"]).withColumn(c, F.col("_v")).drop("_v", "_i")).select(F.lit(c).alias("feature"), "e")
        out = m if out is None else out.unionByName(m)
    return out.crossJoin(base).select("feature", (F.col("e") - F.col("base")).alias("increase"))


def row_windows(df: DataFrame, keys: list[str], order: str, value: str, sizes: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Mean, deviation, extremes, MAD (two passes) and change of `value` over the last w rows, where w rows are there."""
    out = df
    for n in sizes:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
        full: Column = F.count(value).over(w) == n
        cols = {"mean": F.avg(value).over(w), "sd": F.stddev_samp(value).over(w), "min": F.min(value).over(w), "max": F.max(value).over(w), "delta": F.col(value) - F.first(value).over(w), "_med": F.percentile(value, 0.5).over(w)}
        out = out.withColumns({f"{value}_{k}_{n}": F.when(full, c) for k, c in cols.items()})
        out = out.withColumn("_dev", F.abs(F.col(value) - F.col(f"{value}__med_{n}")))
        out = out.withColumn(f"{value}_mad_{n}", F.when(full, F.percentile("_dev", 0.5).over(w))).drop("_dev", f"{value}__med_{n}")
    return out


def inject(df: DataFrame, instances: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Apply fault instances (keys, start, length, kind, size): gradual_shift, spike, noise_burst, stuck_value. Adds fault.

    Instances are listed row by row (they are short) and joined on (keys, row): no range join.
    """
    rows = instances.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("length") - 1))).withColumn(index, F.col("start") + F.col("_k"))
    first = df.select(*keys, F.col(index).alias("start"), F.col(value).alias("_v0"))
    rows = rows.join(first, [*keys, "start"], "left").select(*keys, index, "kind", "size", "_k", "length", "_v0")
    noise = (F.pmod(F.xxhash64(*keys, index), F.lit(2001)) - 1000) / 1000.0
    v = F.col(value)
    made = F.when(F.col("kind") == "gradual_shift", v + F.col("size") * (F.col("_k") + 1) / F.col("length")).when(F.col("kind") == "spike", v + F.col("size")).when(F.col("kind") == "noise_burst", v + F.col("size") * noise).when(F.col("kind") == "stuck_value", F.col("_v0")).otherwise(v)
    return df.join(rows, [*keys, index], "left").withColumn(value, made).withColumn("fault", F.col("kind")).drop("kind", "size", "_k", "length", "_v0")


def rule_detectors(df: DataFrame, value: str, n: int = 20) -> DataFrame:
    """robust_flag and z_flag: further than three robust or plain deviations from the window's mean."""
    far = F.abs(F.col(value) - F.col(f"{value}_mean_{n}"))
    return df.withColumns({"robust_flag": F.coalesce(far > 3 * 1.4826 * F.col(f"{value}_mad_{n}"), F.lit(False)), "z_flag": F.coalesce(far > 3 * F.col(f"{value}_sd_{n}"), F.lit(False))})
