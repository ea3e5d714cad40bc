"""Queries that fit models: forecasts from hourly features, and the fault study on 30-second rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import INDICATORS
from ..functions import scores
from ..operators import features, learn
from ..session import Scratch
from . import hourly, sensor, studies

COLS = [*INDICATORS, *[f"{i}_mean_6h" for i in INDICATORS], *[f"{i}_std_24h" for i in INDICATORS], "hour_sin", "hour_cos"]
R = lambda *c: [F.round(x, 4).alias(x) for x in c]


def _table(spark, sf_dir):
    x = features.time_split(features.targets(features.rolling(hourly.indexed(spark, sf_dir)), ["I"], (3,)))
    x = x.where(F.col("eligible") & F.col("I__h3").isNotNull() & F.col("part").isNotNull())
    return Scratch(spark, "learning").keep(x.select("home", "time", "part", "I", F.col("I__h3").alias("y"), *COLS), "table")


def forecast_regression(spark, sf_dir):
    x = _table(spark, sf_dir)
    test = x.where("part = 'test'")
    naive = test.agg(F.lit("persistence").alias("model"), F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y") - F.col("I"))).alias("mae"), F.sqrt(F.avg(F.pow(F.col("y") - F.col("I"), 2))).alias("rmse"))
    return learn.regress(x.where("part = 'train'"), test, COLS).unionByName(naive).select("model", "n", *R("mae", "rmse"))


def forecast_classes(spark, sf_dir):
    x = _table(spark, sf_dir).withColumn("y", (scores.class_of_score(F.col("y")) >= 3).cast("double"))
    return learn.classify(x.where("part = 'train'"), x.where("part = 'test'"), COLS).select("model", "n", "tp", "fp", "fn", *R("accuracy"))


def forecast_tuned(spark, sf_dir):
    """The ridge penalty and the tree's depth, chosen by three expanding folds of the training time."""
    x = _table(spark, sf_dir).where("part = 'train'")
    q = x.agg(F.percentile(features.seconds("time"), [0.25, 0.5, 0.75]).alias("q")).first()["q"]
    s, edges = features.seconds("time"), [*q, float("inf")]
    folds = [(s < edges[k], (s >= edges[k]) & (s < edges[k + 1])) for k in range(3)]
    grid = [(f"ridge {r}", learn.LinearRegression(featuresCol="x", labelCol="y", regParam=r, elasticNetParam=0.0)) for r in (0.1, 1.0, 10.0)]
    grid += [(f"tree {d}", learn.DecisionTreeRegressor(featuresCol="x", labelCol="y", maxDepth=d, seed=1)) for d in (3, 6)]
    return learn.tune(x, COLS, grid, folds).select("params", *R("cv_mae"), "chosen")


def forecast_unseen_homes(spark, sf_dir):
    """Ridge fitted on other homes before their cut, tested on unseen ones after it, beside persistence: a row a fold."""
    x = _table(spark, sf_dir)
    g = Scratch(spark, "unseen").keep(x.join(F.broadcast(studies._grouped(x, studies.FOLDS)), "home"), "table")  # one row a home
    out = None
    for fold in sorted(r["grp"] for r in g.select("grp").distinct().collect()):  # at most FOLDS
        e = learn.assembled(COLS, learn.REGRESSORS["ridge"]()).fit(g.where((F.col("grp") != fold) & (F.col("part") == "train"))).transform(g.where((F.col("grp") == fold) & (F.col("part") == "test")))
        m = e.agg(F.lit(fold).alias("fold"), F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("mae"), F.avg(F.abs(F.col("y") - F.col("I"))).alias("mae_persistence"))
        out = m if out is None else out.unionByName(m)
    return out.select("fold", "n", *R("mae", "mae_persistence"))


def forecast_by_indicators(spark, sf_dir):
    """Each indicator forecast by a ridge of its own, the index computed from the five, beside the index forecast directly."""
    x = features.targets(features.rolling(hourly.indexed(spark, sf_dir)), [*INDICATORS, "I"], (3,))
    x = features.time_split(x).where(F.col("eligible") & F.col("part").isNotNull() & F.col("I__h3").isNotNull())
    x = Scratch(spark, "indicators").keep(x.select("home", "time", "part", *COLS, "I", *[F.col(f"{i}__h3").alias(f"then_{i}") for i in (*INDICATORS, "I")]), "table")
    out = x.where("part = 'test'")
    for i in (*INDICATORS, "I"):
        model = learn.assembled(COLS, learn.REGRESSORS["ridge"]()).fit(x.where("part = 'train'").withColumn("y", F.col(f"then_{i}")))
        out = model.transform(out).drop("raw", "x").withColumnRenamed("prediction", f"f_{i}")
    y = out.select("home", F.col("I").alias("now"), "then_I", F.col("f_I").alias("direct"), *[F.col(f"f_{i}").alias(i) for i in INDICATORS])
    z = scores.with_index(y)
    err = lambda c: F.avg(F.abs(F.col(c) - F.col("then_I")))
    return z.groupBy("home").agg(F.count(F.lit(1)).alias("n"), err("direct").alias("mae_a"), err("I").alias("mae_b"), err("now").alias("mae_persistence")).select("home", "n", *R("mae_a", "mae_b", "mae_persistence"))


def forecast_importance(spark, sf_dir):
    x = _table(spark, sf_dir)
    model = learn.assembled(COLS, learn.REGRESSORS["ridge"]()).fit(x.where("part = 'train'"))
    return learn.importance(model, x.where("part = 'test'"), COLS).select("feature", *R("increase"))


def _study(spark, sf_dir):
    """Rows with injected faults, one instance per hundred rows of each device, window features and rule flags."""
    m = sensor.matched(spark, sf_dir).select("device", "slot", "co2")
    x = m.withColumn("i", F.row_number().over(Window.partitionBy("device").orderBy("slot")).cast("bigint"))
    kinds = F.array(*[F.lit(k) for k in ("gradual_shift", "spike", "noise_burst", "stuck_value")])
    k = F.pmod(F.xxhash64("device", "block"), F.lit(4)).cast("int")
    at = x.groupBy("device", F.floor(F.col("i") / 100).alias("block")).agg(F.count(F.lit(1)).alias("n")).where("n >= 60")
    inst = at.select("device", (F.col("block") * 100 + 30 + F.pmod(F.xxhash64("block", "device"), F.lit(20))).alias("start"), F.when(k == 1, 1).otherwise(12).alias("length"), F.get(kinds, k).alias("kind"), F.lit(150.0).alias("size"))
    y = learn.inject(x, inst, ["device"], "i", "co2")
    return learn.rule_detectors(learn.row_windows(y, ["device"], "i", "co2"), "co2")


def fault_study_rules(spark, sf_dir):
    x = _study(spark, sf_dir)
    return x.groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count(F.lit(1)).alias("n"), F.count_if("robust_flag").alias("n_robust"), F.count_if("z_flag").alias("n_z"))


def fault_study_models(spark, sf_dir):
    cols = ["co2", *[f"co2_{k}_{n}" for n in (5, 20) for k in ("mean", "sd", "min", "max", "delta", "mad")]]
    x = Scratch(spark, "faults").keep(_study(spark, sf_dir).select("device", "i", F.col("fault").isNotNull().cast("double").alias("y"), *cols), "rows")
    split = F.pmod(F.xxhash64(F.floor(F.col("i") / 100), "device"), F.lit(10)) < 7
    return learn.classify(x.where(split), x.where(~split), cols).select("model", "n", "tp", "fp", "fn", *R("accuracy"))


QUERIES = {f.__name__: f for f in (forecast_regression, forecast_classes, forecast_tuned, forecast_unseen_homes, forecast_by_indicators, forecast_importance, fault_study_rules, fault_study_models)}
SQL: dict[str, str] = {}
