"""Queries over the hourly readings: grid, index, distributions, correlations, features, targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import INDICATORS, IndexConfig
from ..functions import scores, stats
from ..operators import features, sequence
from ..sources.adapters import HOURLY, readings_hourly
from . import sqltext

PAIRS = [(a, b) for i, a in enumerate(INDICATORS) for b in INDICATORS[i + 1 :]]
EPISODES = {"pm25": 25.0, "co2": 1220.0, "I": 50.0}


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.grid(readings_hourly(spark, sf_dir))


def indexed(spark: SparkSession, sf_dir: str, cfg: IndexConfig | None = None) -> DataFrame:
    return scores.with_index(grid(spark, sf_dir), cfg)


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


def hourly_grid(spark, sf_dir):
    return grid(spark, sf_dir).select("home", "time", "observed", "season", *r6(*INDICATORS))


def invalid_rules(spark, sf_dir):
    return features.invalid_counts(readings_hourly(spark, sf_dir))


def index_hourly(spark, sf_dir):
    cols = [f"d_{i}" for i in INDICATORS] + ["Q_A", "Q_V", "Q_M", "Q_mean", "Q_max", "delta", "I"]
    return indexed(spark, sf_dir).select("home", "time", *r6(*cols), "class_I", "class_A", "class_V", "class_M")


def index_share(spark, sf_dir):
    """Flagship: share of hours in each class of the index, by home and season."""
    x = indexed(spark, sf_dir).where(scores.complete())
    return x.groupBy("home", "season", "class_I").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("I"), 6).alias("mean_I"))


def class_distribution(spark, sf_dir):
    """Counts of each class for each entity at four levels of grouping, zero-filled: grouping sets in one pass over the rows."""
    x = indexed(spark, sf_dir).where(scores.complete()).select(F.col("home").cast("string").alias("home"), "season", F.expr("stack(4, 'I', class_I, 'A', class_A, 'V', class_V, 'M', class_M) as (entity, rank)"))
    counts = x.groupingSets([["entity", "home", "season"], ["entity", "home"], ["entity", "season"], ["entity"]], "entity", "home", "season").agg(
        *[F.count_if(F.col("rank") == k).alias(f"n{k}") for k in range(5)], F.count(F.lit(1)).alias("total")
    )
    rows = F.array(*[F.struct(F.lit(k).alias("rank"), F.col(f"n{k}").alias("n")) for k in range(5)])
    return counts.select("entity", F.coalesce("home", F.lit("ALL")).alias("home"), F.coalesce("season", F.lit("ALL")).alias("season"), F.inline(rows), "total").withColumn("share", F.round(F.col("n") / F.col("total"), 6)).drop("total")


def dataset_table(spark, sf_dir):
    """Rows, days and missing shares per home with a total row; the total's days are the sum over homes."""
    g = grid(spark, sf_dir)
    per = g.groupBy(F.col("home").cast("string").alias("home")).agg(F.count(F.lit(1)).alias("hours"), F.count_if("observed").alias("observed"), F.countDistinct(F.to_date("time")).alias("days"), *[F.count_if(F.col(i).isNull()).alias(f"m_{i}") for i in INDICATORS])
    cols = ["hours", "observed", "days", *[f"m_{i}" for i in INDICATORS]]
    both = per.rollup("home").agg(*[F.sum(c).alias(c) for c in cols])
    return both.select(F.coalesce("home", F.lit("ALL")).alias("home"), "hours", "observed", "days", *[F.round(F.col(f"m_{i}") / F.col("hours"), 6).alias(f"missing_{i}") for i in INDICATORS])


def dominance_shares(spark, sf_dir):
    """Share of hours over the threshold that each component dominates, at four levels."""
    x = scores.dominance(indexed(spark, sf_dir)).withColumn("home", F.col("home").cast("string"))
    many = F.col("dom_A").cast("int") + F.col("dom_V").cast("int") + F.col("dom_M").cast("int") > 1
    out = x.groupingSets([["home", "season"], ["home"], ["season"], []], "home", "season").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col(f"dom_{c}").cast("int")), 6).alias(f"share_{c}") for c in "AVM"], F.round(F.avg(many.cast("int")), 6).alias("share_multi"))
    return out.withColumns({k: F.coalesce(k, F.lit("ALL")) for k in ("home", "season")}).where("n > 0")


def contribution_over_homes(spark, sf_dir):
    """Median and quartiles over homes of each component's share."""
    per = scores.dominance(indexed(spark, sf_dir)).groupBy("home").agg(*[F.avg(F.col(f"dom_{c}").cast("int")).alias(c) for c in "AVM"])
    long = per.selectExpr("stack(3, 'A', A, 'V', V, 'M', M) as (component, share)")
    return long.groupBy("component").agg(*[F.round(F.percentile("share", q), 6).alias(n) for n, q in (("median", 0.5), ("q1", 0.25), ("q3", 0.75))])


VARIANTS = {"base": {}, "pm10_separate": {"pm10_separate": True}, "t_low_17": {"t_low": (21.0, 20.0, 18.0, 17.0, 16.0)}, "co2_400": {"co2_outdoor": 400.0}}


def sensitivity_variants(spark, sf_dir):
    """Mean index, share of low and critical hours, and agreement with the base, under changed settings: one scan, side by side."""
    g = grid(spark, sf_dir)
    out = None
    base = scores.with_index(g.where(scores.complete())).select("home", "time", F.col("class_I").alias("base_class"))
    for name, change in VARIANTS.items():
        x = scores.with_index(g.where(scores.complete()), IndexConfig().variant(**change)).select("home", "time", F.lit(name).alias("variant"), "I", "class_I")
        out = x if out is None else out.unionByName(x)
    both = out.join(base, ["home", "time"])
    return both.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("I"), 6).alias("mean_I"), F.round(F.avg((F.col("class_I") >= 3).cast("int")), 6).alias("share_bad"), F.round(F.avg((F.col("class_I") == F.col("base_class")).cast("int")), 6).alias("agreement"))


def compare_rules(spark, sf_dir):
    """The index against the plain mean and the plain maximum: agreement, hours more than a class better, critical ones hidden."""
    x = indexed(spark, sf_dir).where(scores.complete())
    rules = F.expr("stack(2, 'mean', Q_mean, 'max', Q_max) as (rule, score)")
    y = x.select("class_I", "Q_max", rules).withColumn("rank", scores.class_of_score(F.col("score")))
    worst = scores.class_of_score(F.col("Q_max"))
    return y.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("rank") == F.col("class_I")).cast("int")), 6).alias("agreement"), F.count_if(worst - F.col("rank") > 1).alias("n_much_better"), F.count_if((worst == 4) & (F.col("rank") < 3)).alias("n_hidden_critical"), F.round(F.avg("score"), 6).alias("mean_score"))


def class_crosstab(spark, sf_dir):
    """Class of the index against the class of its largest component."""
    x = indexed(spark, sf_dir).where(scores.complete()).withColumn("worst", scores.class_of_score(F.col("Q_max")))
    return x.groupBy("class_I").pivot("worst", [0, 1, 2, 3, 4]).count().na.fill(0).select("class_I", *[F.col(str(k)).cast("bigint").alias(f"w{k}") for k in range(5)])


def indicator_correlations(spark, sf_dir):
    """Pairwise-complete Spearman and Pearson per home and season for all ten pairs: one exchange, pairs stacked."""
    g = grid(spark, sf_dir)
    pairs = ", ".join(f"'{a}-{b}', {a}, {b}" for a, b in PAIRS)
    long = g.select("home", "season", F.expr(f"stack({len(PAIRS)}, {pairs}) as (pair, x, y)")).where("x is not null and y is not null")
    rho = stats.spearman(long, ["home", "season", "pair"], "x", "y")
    r = long.groupBy("home", "season", "pair").agg(F.corr("x", "y").alias("r"))
    return rho.join(r, ["home", "season", "pair"]).select("home", "season", "pair", "n", *r6("rho", "r"))


def pm_merge_rule(spark, sf_dir):
    """Whether the two PM indicators may be one component: high median rank correlation per season, few with weak ones."""
    g = grid(spark, sf_dir)
    rho = stats.spearman(g, ["home", "season"], "pm25", "pm10").where("n >= 200")
    out = rho.groupBy("season").agg(F.count(F.lit(1)).alias("homes"), F.round(F.percentile("rho", 0.5), 6).alias("median_rho"), F.round(F.avg((F.col("rho") <= 0.9).cast("int")), 6).alias("share_weak"))
    return out.withColumn("merge", (F.col("median_rho") > 0.9) & (F.col("share_weak") <= 0.05))


def episodes(spark, sf_dir):
    """Stretches of hours over a limit, for three series: how many, how long."""
    x = indexed(spark, sf_dir)
    parts = ", ".join(f"'{c}', {c} > {v}" for c, v in EPISODES.items())
    long = x.select("home", "time", F.expr(f"stack({len(EPISODES)}, {parts}) as (series, over)"))
    got = sequence.runs(long, ["home", "series"], "time", F.col("over"))
    return got.groupBy("home", "series").agg(F.count(F.lit(1)).alias("n_episodes"), F.sum("n").alias("hours"), F.max("n").alias("longest"), F.round(F.percentile("n", 0.5), 6).alias("median_len"))


def series_gaps(spark, sf_dir):
    return sequence.gaps(readings_hourly(spark, sf_dir), "home", "time", 3_600_000_000).select("home", "gap_start", "gap_end", F.round("gap_s", 6).alias("gap_s"))


def channel_audit(spark, sf_dir):
    """Coverage, range, moments, distinct values and flat stretches of each indicator."""
    g = grid(spark, sf_dir)
    parts = ", ".join(f"'{i}', {i}" for i in INDICATORS)
    long = g.select("home", "time", F.expr(f"stack({len(INDICATORS)}, {parts}) as (channel, v)"))
    a = long.groupBy("channel").agg(F.count("v").alias("n"), F.round(F.count("v") / F.count(F.lit(1)), 6).alias("coverage"), F.round(F.min("v"), 6).alias("lo"), F.round(F.max("v"), 6).alias("hi"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sd"), F.countDistinct("v").alias("n_distinct"))
    w = Window.partitionBy("home", "channel").orderBy("time")
    flat = sequence.runs(long.withColumn("same", F.col("v") == F.lag("v").over(w)), ["home", "channel"], "time", F.col("same"))
    f = flat.groupBy("channel").agg(F.count_if(F.col("n") >= 2).alias("n_flat"), F.max("n").alias("longest_flat"))
    return a.join(f, "channel", "left").na.fill(0, ["n_flat", "longest_flat"])


def snapshot_verification(spark, sf_dir):
    """Rows, span, repeated times, order violations and gap histogram of each series."""
    x = readings_hourly(spark, sf_dir)
    w = Window.partitionBy("home").orderBy("time")
    y = x.withColumn("gap", F.unix_seconds(F.col("time").cast("timestamp")) - F.unix_seconds(F.lag("time").over(w).cast("timestamp")))
    return y.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last"), F.count_if(F.col("gap") == 0).alias("n_repeated"), F.count_if(F.col("gap") == 3600).alias("n_regular"), F.count_if(F.col("gap") == 7200).alias("n_two_hours"), F.count_if(F.col("gap") > 7200).alias("n_longer"), F.count_if(F.col("co2").isNull()).alias("n_null_co2"))


def class_transitions(spark, sf_dir):
    x = sequence.transitions(indexed(spark, sf_dir).where(scores.complete()), "home", "time", "class_I", 2 * 3_600_000_000)
    return x.groupBy("home", F.coalesce("kind", F.lit("first")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if("reversal").alias("n_reversals"))


def class_dwell(spark, sf_dir):
    x = sequence.dwell(indexed(spark, sf_dir).where(scores.complete()), "home", "time", "class_I", 2 * 3_600_000_000)
    return x.groupBy("home", "class_I").agg(F.count(F.lit(1)).alias("n_stays"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean_len"))


def rolling_features(spark, sf_dir):
    x = features.rolling(indexed(spark, sf_dir)).where("eligible")
    cols = [f"{i}_{s}_{w}h" for i in INDICATORS for w in features.WINDOWS for s in ("mean", "min", "max", "std")] + [f"diff1_{i}" for i in INDICATORS] + ["hour_sin", "hour_cos"]
    return x.select("home", "time", *r6(*cols), "weekend", "season_heating")


def forecast_targets(spark, sf_dir):
    x = features.targets(indexed(spark, sf_dir), ["I", "co2"])
    cols = [f"{c}__h{h}{s}" for c in ("I", "co2") for h in (1, 3, 6) for s in ("", "_lag24")]
    return x.select("home", "time", *r6(*cols))


def horizons(spark, sf_dir):
    """Persistence and same-hour-yesterday errors per series and horizon on their common hours."""
    x = features.targets(indexed(spark, sf_dir), ["I", "co2"])
    parts = ", ".join(f"'{c}', {h}, {c}, {c}__h{h}, {c}__h{h}_lag24" for c in ("I", "co2") for h in (1, 3, 6))
    long = x.select("home", F.expr(f"stack(6, {parts}) as (series, h, now, then, day)")).where("now is not null and then is not null and day is not null")
    return long.groupBy("series", "h", "home").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("then") - F.col("now"))), 6).alias("mae_persistence"), F.round(F.avg(F.abs(F.col("then") - F.col("day"))), 6).alias("mae_day"), F.round(F.sqrt(F.avg(F.pow(F.col("then") - F.col("now"), 2))), 6).alias("rmse"), F.round(F.corr("now", "then"), 6).alias("r"))


def forecast_metrics(spark, sf_dir):
    """Error of the persistence forecast of I on test hours: per season, and median and quartiles over homes; class scores."""
    x = features.time_split(features.targets(indexed(spark, sf_dir), ["I", "class_I"], (3,))).where((F.col("part") == "test") & F.col("I").isNotNull() & F.col("I__h3").isNotNull())
    per = x.groupBy("home").agg(F.avg(F.abs(F.col("I__h3") - F.col("I"))).alias("mae"))
    spread = per.agg(F.round(F.percentile("mae", 0.5), 6).alias("mae_median"), F.round(F.percentile("mae", 0.25), 6).alias("mae_q1"), F.round(F.percentile("mae", 0.75), 6).alias("mae_q3"))
    k = stats.agreement(x, [], "class_I", "class_I__h3", 5).select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"), F.round("macro_f1_zero", 6).alias("macro_f1"))
    return k.crossJoin(spread)


def time_split(spark, sf_dir):
    return features.time_split(grid(spark, sf_dir)).groupBy("home", F.coalesce("part", F.lit("gap")).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))


def cross_correlation_lag(spark, sf_dir):
    x = readings_hourly(spark, sf_dir)
    return sequence.best_lag(x, "home", "time", "t", "rh").select("home", "lag", F.round("r", 6).alias("r"), "n")


def widest_week(spark, sf_dir):
    """The 168-hour window with the largest spread of I in each home."""
    x = indexed(spark, sf_dir)
    w = features.hours_back("home", "time", 168)
    y = x.withColumns({"sd": F.stddev_samp("I").over(w), "n": F.count("I").over(w)}).where("n >= 120")
    return y.groupBy("home").agg(F.max_by(F.struct("time", F.round("sd", 6).alias("sd")), F.struct(F.round("sd", 6), -F.unix_seconds(F.col("time").cast("timestamp")))).alias("b")).select("home", "b.time", "b.sd")


def pair_statistics(spark, sf_dir):
    x = grid(spark, sf_dir)
    got = stats.pair_stats(x.withColumn("day", F.to_date("time")), ["home"], "pm10", "pm25")
    return got.select("home", "n", *r6("bias", "bias_median", "bias_sd", "pearson", "slope", "mad"))


def humidity_absolute(spark, sf_dir):
    x = grid(spark, sf_dir).where("t is not null and rh is not null")
    return x.groupBy("home").agg(F.round(F.avg(scores.absolute_humidity(F.col("t"), F.col("rh"))), 6).alias("ah_mean"), F.round(F.max(scores.absolute_humidity(F.col("t"), F.col("rh"))), 6).alias("ah_max"))


def rolling_correlation(spark, sf_dir):
    """Correlation of two channels over the last 24 rows; 0 with a flag where one does not vary."""
    w = Window.partitionBy("home").orderBy("time").rowsBetween(-23, 0)
    x = readings_hourly(spark, sf_dir).where("co2 is not null and t is not null")
    y = x.withColumns({"n": F.count(F.lit(1)).over(w), "r": F.corr("co2", "t").over(w), "flat": (F.round(F.stddev_samp("co2").over(w), 9) == 0) | (F.round(F.stddev_samp("t").over(w), 9) == 0)}).where("n = 24")
    return y.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("flat"), 0.0).otherwise(F.col("r"))), 5).alias("mean_r"), F.count_if("flat").alias("n_flat"))


def robust_scores(spark, sf_dir):
    """Centred two-pass robust deviation per home and month, and runs of at least four high hours."""
    x = readings_hourly(spark, sf_dir).where("co2 is not null").withColumn("month", F.month("time"))
    w = Window.partitionBy("home", "month").orderBy("time").rowsBetween(-24, 24)
    y = x.withColumns({"m": F.percentile("co2", 0.5).over(w), "n": F.count("co2").over(w)}).withColumn("d", F.abs(F.col("co2") - F.col("m")))
    y = y.withColumn("mad", F.percentile("d", 0.5).over(w) * 1.4826)
    y = y.withColumn("score", F.when((F.col("n") >= 25) & (F.col("mad") > 0), F.col("d") / F.col("mad")))
    return y.groupBy("home", "month").agg(F.count("score").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.max("score"), 6).alias("max_score"), F.count_if(F.col("score") > 1.5).alias("n_high"))


QUERIES = {f.__name__: f for f in (hourly_grid, invalid_rules, index_hourly, index_share, class_distribution, dataset_table, dominance_shares, contribution_over_homes, sensitivity_variants, compare_rules, class_crosstab, indicator_correlations, pm_merge_rule, episodes, series_gaps, channel_audit, snapshot_verification, class_transitions, class_dwell, rolling_features, forecast_targets, horizons, forecast_metrics, time_split, cross_correlation_lag, widest_week, pair_statistics, humidity_absolute, rolling_correlation, robust_scores)}

_G, _I = f"WITH {sqltext.GRID}", f"WITH {sqltext.GRID}, {sqltext.index()}"
_ROUND = lambda *c: ", ".join(f'round("{x}", 6) AS "{x}"' for x in c)
_ALL = "coalesce(home::VARCHAR, 'ALL') AS home, coalesce(season, 'ALL') AS season"
_AGG = "(partition by home, pair order by"
_REL = [f"{i}_{s}_{w}h" for i in INDICATORS for w in features.WINDOWS for s in ("mean", "min", "max", "std")]
_FN = {"mean": "avg", "min": "min", "max": "max", "std": "stddev_samp"}
_FRAME = lambda w: f"OVER (PARTITION BY home ORDER BY epoch(time)::BIGINT RANGE BETWEEN {w * 3600 - 1} PRECEDING AND CURRENT ROW)"
_T = lambda c, h: f'lead("{c}", {h}) OVER (PARTITION BY home ORDER BY time) AS "{c}__h{h}", lag("{c}", {24 - h}) OVER (PARTITION BY home ORDER BY time) AS "{c}__h{h}_lag24"'
_TARGETS = ", ".join(_T(c, h) for c in ("I", "co2") for h in (1, 3, 6))
_ISLAND = "sum(CASE WHEN {new} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY time)"


def _variants() -> str:
    ctes = ", ".join(sqltext.index(IndexConfig().variant(**c), f"v_{n}") for n, c in VARIANTS.items())
    rows = " UNION ALL ".join(f"SELECT '{n}' AS variant, home, time, \"I\", \"class_I\" FROM v_{n}" for n in VARIANTS)
    return f"""WITH {sqltext.GRID}, {ctes}, al AS ({rows})
SELECT variant, count(*) AS n, round(avg(a."I"), 6) AS "mean_I", round(avg((a."class_I" >= 3)::INT), 6) AS share_bad,
 round(avg((a."class_I" = b."class_I")::INT), 6) AS agreement
FROM al a JOIN v_base b USING (home, time) WHERE a."I" IS NOT NULL GROUP BY variant"""


SQL = {
    "hourly_grid": f"{_G} SELECT home, time, observed, season, {_ROUND(*INDICATORS)} FROM grid",
    "invalid_rules": f"""WITH {HOURLY}
SELECT 'co2_below_min' AS rule, 'co2' AS indicator, count_if(co2 < 350)::BIGINT AS n_removed, count(co2) AS n_present FROM readings
UNION ALL SELECT 'co2_error_code', 'co2', count_if(co2 = 9999)::BIGINT, count(co2) FROM readings
UNION ALL SELECT 'pm25_above_max', 'pm25', count_if(pm25 > 1000)::BIGINT, count(pm25) FROM readings
UNION ALL SELECT 'pm10_above_max', 'pm10', count_if(pm10 > 1000)::BIGINT, count(pm10) FROM readings
UNION ALL SELECT 't_out_of_range', 't', count_if(t < 5 OR t > 40)::BIGINT, count(t) FROM readings
UNION ALL SELECT 'rh_out_of_range', 'rh', count_if(rh < 5 OR rh > 95)::BIGINT, count(rh) FROM readings""",
    "index_hourly": f"""{_I} SELECT home, time, {_ROUND(*[f'd_{i}' for i in INDICATORS], 'Q_A', 'Q_V', 'Q_M', 'Q_mean', 'Q_max', 'delta', 'I')}, "class_I", "class_A", "class_V", "class_M" FROM idx""",
    "index_share": f"""{_I} SELECT home, season, "class_I", count(*) AS n, round(avg("I"), 6) AS "mean_I" FROM idx WHERE "I" IS NOT NULL GROUP BY ALL""",
    "class_distribution": f"""{_I}, l AS (
 SELECT home, season, 'I' AS entity, "class_I" AS r FROM idx WHERE "I" IS NOT NULL UNION ALL SELECT home, season, 'A', "class_A" FROM idx WHERE "I" IS NOT NULL
 UNION ALL SELECT home, season, 'V', "class_V" FROM idx WHERE "I" IS NOT NULL UNION ALL SELECT home, season, 'M', "class_M" FROM idx WHERE "I" IS NOT NULL),
g AS (SELECT entity, {_ALL}, r, count(*) AS n FROM l GROUP BY GROUPING SETS ((entity, home, season, r), (entity, home, r), (entity, season, r), (entity, r))),
k AS (SELECT DISTINCT entity, home, season FROM g)
SELECT k.entity, k.home, k.season, c.k::INT AS rank, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY k.entity, k.home, k.season), 6) AS share
FROM k CROSS JOIN (SELECT unnest(range(5)) AS k) c LEFT JOIN g ON g.entity = k.entity AND g.home = k.home AND g.season = k.season AND g.r = c.k""",
    "dataset_table": f"""{_G}, p AS (SELECT home::VARCHAR AS home, count(*) AS hours, count_if(observed) AS observed, count(DISTINCT time::DATE) AS days, {', '.join(f'count_if({i} IS NULL) AS m_{i}' for i in INDICATORS)} FROM grid GROUP BY 1)
SELECT coalesce(home, 'ALL') AS home, sum(hours)::BIGINT AS hours, sum(observed)::BIGINT AS observed, sum(days)::BIGINT AS days, {', '.join(f'round(sum(m_{i}) / sum(hours), 6) AS missing_{i}' for i in INDICATORS)} FROM p GROUP BY ROLLUP (home)""",
    "dominance_shares": f"""{_I}, d AS (SELECT home, season, ("Q_A" >= "Q_max" - 1)::INT AS a, ("Q_V" >= "Q_max" - 1)::INT AS v, ("Q_M" >= "Q_max" - 1)::INT AS m FROM idx WHERE "I" > 25)
SELECT {_ALL}, count(*) AS n, round(avg(a), 6) AS "share_A", round(avg(v), 6) AS "share_V", round(avg(m), 6) AS "share_M", round(avg((a + v + m > 1)::INT), 6) AS share_multi
FROM d GROUP BY GROUPING SETS ((home, season), (home), (season), ())""",
    "contribution_over_homes": f"""{_I}, p AS (SELECT home, avg(("Q_A" >= "Q_max" - 1)::INT) AS a, avg(("Q_V" >= "Q_max" - 1)::INT) AS v, avg(("Q_M" >= "Q_max" - 1)::INT) AS m FROM idx WHERE "I" > 25 GROUP BY home),
l AS (SELECT 'A' AS component, a AS s FROM p UNION ALL SELECT 'V', v FROM p UNION ALL SELECT 'M', m FROM p)
SELECT component, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.25), 6) AS q1, round(quantile_cont(s, 0.75), 6) AS q3 FROM l GROUP BY component""",
    "sensitivity_variants": _variants(),
    "compare_rules": f"""{_I}, l AS (SELECT 'mean' AS rule, "class_I", "Q_max", "Q_mean" AS s FROM idx WHERE "I" IS NOT NULL UNION ALL SELECT 'max', "class_I", "Q_max", "Q_max" FROM idx WHERE "I" IS NOT NULL),
k AS (SELECT *, greatest(0, least(4, ceil(s / 25.0::DOUBLE)::INT)) AS r, greatest(0, least(4, ceil("Q_max" / 25.0::DOUBLE)::INT)) AS w FROM l)
SELECT rule, count(*) AS n, round(avg((r = "class_I")::INT), 6) AS agreement, count_if(w - r > 1)::BIGINT AS n_much_better, count_if(w = 4 AND r < 3)::BIGINT AS n_hidden_critical, round(avg(s), 6) AS mean_score FROM k GROUP BY rule""",
    "class_crosstab": f"""{_I}, k AS (SELECT "class_I", greatest(0, least(4, ceil("Q_max" / 25.0::DOUBLE)::INT)) AS w FROM idx WHERE "I" IS NOT NULL)
SELECT "class_I", {', '.join(f'count_if(w = {k})::BIGINT AS w{k}' for k in range(5))} FROM k GROUP BY "class_I" """,
    "indicator_correlations": f"""{_G}, l AS ({' UNION ALL '.join(f"SELECT home, season, '{a}-{b}' AS pair, {a} AS x, {b} AS y FROM grid WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in PAIRS)}),
r AS (SELECT *, rank() OVER (PARTITION BY home, season, pair ORDER BY x) + (count(*) OVER (PARTITION BY home, season, pair, x) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER (PARTITION BY home, season, pair ORDER BY y) + (count(*) OVER (PARTITION BY home, season, pair, y) - 1) / 2.0::DOUBLE AS ry FROM l)
SELECT home, season, pair, count(*) AS n, round(corr(rx, ry), 6) AS rho, round(corr(x, y), 6) AS r FROM r GROUP BY home, season, pair""",
    "pm_merge_rule": f"""{_G}, l AS (SELECT home, season, pm25 AS x, pm10 AS y FROM grid WHERE pm25 IS NOT NULL AND pm10 IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY home, season ORDER BY x) + (count(*) OVER (PARTITION BY home, season, x) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER (PARTITION BY home, season ORDER BY y) + (count(*) OVER (PARTITION BY home, season, y) - 1) / 2.0::DOUBLE AS ry FROM l),
p AS (SELECT home, season, corr(rx, ry) AS rho FROM r GROUP BY home, season HAVING count(*) >= 200)
SELECT season, count(*) AS homes, round(quantile_cont(rho, 0.5), 6) AS median_rho, round(avg((rho <= 0.9)::INT), 6) AS share_weak, quantile_cont(rho, 0.5) > 0.9 AND avg((rho <= 0.9)::INT) <= 0.05 AS merge FROM p GROUP BY season""",
    "episodes": f"""{_I}, l AS ({' UNION ALL '.join(f"SELECT home, time, '{c}' AS series, coalesce(\"{c}\" > {v}, false) AS f FROM idx" for c, v in EPISODES.items())}),
m AS (SELECT *, f IS DISTINCT FROM lag(f) OVER (PARTITION BY home, series ORDER BY time) AS new FROM l), g AS (SELECT *, {_ISLAND.format(new='new', key='home, series')} AS g FROM m),
e AS (SELECT home, series, g, count(*) AS n FROM g WHERE f GROUP BY ALL)
SELECT home, series, count(*) AS n_episodes, sum(n)::BIGINT AS hours, max(n) AS longest, round(quantile_cont(n, 0.5), 6) AS median_len FROM e GROUP BY home, series""",
    "series_gaps": f"""WITH {HOURLY}, l AS (SELECT home, lag(time) OVER (PARTITION BY home ORDER BY time) AS gap_start, time AS gap_end FROM readings)
SELECT home, gap_start, gap_end, round(epoch(gap_end - gap_start), 6)::DOUBLE AS gap_s FROM l WHERE gap_end - gap_start > INTERVAL 1 HOUR""",
    "channel_audit": f"""{_G}, l AS ({' UNION ALL '.join(f"SELECT home, time, '{i}' AS channel, {i} AS v FROM grid" for i in INDICATORS)}),
a AS (SELECT channel, count(v) AS n, round(count(v) / count(*), 6) AS coverage, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(DISTINCT v) AS n_distinct FROM l GROUP BY channel),
s AS (SELECT *, coalesce(v = lag(v) OVER (PARTITION BY home, channel ORDER BY time), false) AS f FROM l),
m AS (SELECT *, f IS DISTINCT FROM lag(f) OVER (PARTITION BY home, channel ORDER BY time) AS new FROM s), g AS (SELECT *, {_ISLAND.format(new='new', key='home, channel')} AS g FROM m),
e AS (SELECT home, channel, g, count(*) AS k FROM g WHERE f GROUP BY ALL), b AS (SELECT channel, count_if(k >= 2)::BIGINT AS n_flat, max(k) AS longest_flat FROM e GROUP BY channel)
SELECT a.*, coalesce(n_flat, 0)::BIGINT AS n_flat, coalesce(longest_flat, 0)::BIGINT AS longest_flat FROM a LEFT JOIN b USING (channel)""",
    "snapshot_verification": f"""WITH {HOURLY}, l AS (SELECT *, epoch(time)::BIGINT - epoch(lag(time) OVER (PARTITION BY home ORDER BY time))::BIGINT AS gap FROM readings)
SELECT home, count(*) AS n, min(time) AS first, max(time) AS last, count_if(gap = 0)::BIGINT AS n_repeated, count_if(gap = 3600)::BIGINT AS n_regular, count_if(gap = 7200)::BIGINT AS n_two_hours, count_if(gap > 7200)::BIGINT AS n_longer, count_if(co2 IS NULL)::BIGINT AS n_null_co2 FROM l GROUP BY home""",
    "class_transitions": f"""{_I}, l AS (SELECT home, time, "class_I" AS r, lag("class_I") OVER w AS one, lag("class_I", 2) OVER w AS two, epoch(time - lag(time) OVER w) AS age, epoch(lag(time) OVER w - lag(time, 2) OVER w) AS age2 FROM idx WHERE "I" IS NOT NULL WINDOW w AS (PARTITION BY home ORDER BY time)),
k AS (SELECT home, CASE WHEN one IS NULL THEN 'first' WHEN age > 7200 THEN 'gap_excluded' WHEN r = one THEN 'none' WHEN abs(r - one) = 1 THEN 'adjacent' ELSE 'nonadjacent' END AS kind, coalesce(r = two AND r <> one AND age <= 7200 AND age2 <= 7200, false) AS rev FROM l)
SELECT home, kind, count(*) AS n, count_if(rev)::BIGINT AS n_reversals FROM k GROUP BY home, kind""",
    "class_dwell": f"""{_I}, l AS (SELECT home, time, "class_I", "class_I" IS DISTINCT FROM lag("class_I") OVER w OR coalesce(time - lag(time) OVER w > INTERVAL 2 HOUR, true) AS new FROM idx WHERE "I" IS NOT NULL WINDOW w AS (PARTITION BY home ORDER BY time)),
g AS (SELECT *, {_ISLAND.format(new='new', key='home')} AS g FROM l), e AS (SELECT home, g, "class_I", count(*) AS n FROM g GROUP BY ALL)
SELECT home, "class_I", count(*) AS n_stays, max(n) AS longest, round(avg(n), 6) AS mean_len FROM e GROUP BY ALL""",
    "rolling_features": f"""{_I}, f AS (SELECT *, {', '.join(f'{_FN[s]}({i}) {_FRAME(w)} AS {i}_{s}_{w}h' for i in INDICATORS for w in features.WINDOWS for s in _FN)},
 {', '.join(f'count({i}) {_FRAME(w)} / {w}::DOUBLE >= 0.8 AS ok_{i}_{w}' for i in INDICATORS for w in features.WINDOWS)}, {', '.join(f'{i} - lag({i}) OVER (PARTITION BY home ORDER BY time) AS diff1_{i}' for i in INDICATORS)} FROM idx)
SELECT home, time, {_ROUND(*_REL, *[f'diff1_{i}' for i in INDICATORS])}, round(sin(2 * pi() * hour(time) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(time) / 24), 6) AS hour_cos,
 (isodow(time) >= 6)::INT AS weekend, (season = 'heating')::INT AS season_heating FROM f
WHERE "I" IS NOT NULL AND {' AND '.join(f'ok_{i}_{w}' for i in INDICATORS for w in features.WINDOWS)} AND {' AND '.join(f'diff1_{i} IS NOT NULL' for i in INDICATORS)}""",
    "forecast_targets": f"""{_I}, f AS (SELECT home, time, {_TARGETS} FROM idx) SELECT home, time, {_ROUND(*[f'{c}__h{h}{s}' for c in ('I', 'co2') for h in (1, 3, 6) for s in ('', '_lag24')])} FROM f""",
    "horizons": f"""{_I}, f AS (SELECT *, {_TARGETS} FROM idx), l AS ({' UNION ALL '.join(f"SELECT home, '{c}' AS series, {h} AS h, \"{c}\" AS now, \"{c}__h{h}\" AS th, \"{c}__h{h}_lag24\" AS d FROM f" for c in ('I', 'co2') for h in (1, 3, 6))})
SELECT series, h, home, count(*) AS n, round(avg(abs(th - now)), 6) AS mae_persistence, round(avg(abs(th - d)), 6) AS mae_day, round(sqrt(avg(pow(th - now, 2))), 6) AS rmse, round(corr(now, th), 6) AS r
FROM l WHERE now IS NOT NULL AND th IS NOT NULL AND d IS NOT NULL GROUP BY series, h, home""",
    "time_split": f"""{_G}, s AS (SELECT *, epoch(time)::BIGINT AS e, epoch(min(time) OVER (PARTITION BY home))::BIGINT AS a, epoch(max(time) OVER (PARTITION BY home))::BIGINT AS b FROM grid),
p AS (SELECT *, CASE WHEN e <= a + floor((b - a) * 0.75) THEN 'train' WHEN e > a + floor((b - a) * 0.75) + 108000 THEN 'test' ELSE 'gap' END AS part FROM s)
SELECT home, part, count(*) AS n, min(time) AS first, max(time) AS last FROM p GROUP BY home, part""",
    "cross_correlation_lag": f"""WITH {HOURLY}, i AS (SELECT home, t, rh, row_number() OVER (PARTITION BY home ORDER BY time) AS k FROM readings), g AS (SELECT unnest(range(-20, 21))::INT AS lag),
p AS (SELECT a.home, g.lag, corr(a.t, b.rh) AS r, count(*) AS n FROM i a CROSS JOIN g JOIN i b ON a.home = b.home AND b.k = a.k + g.lag WHERE a.t IS NOT NULL AND b.rh IS NOT NULL GROUP BY a.home, g.lag HAVING count(*) >= 30),
o AS (SELECT *, row_number() OVER (PARTITION BY home ORDER BY round(r, 9) DESC, lag) AS q FROM p) SELECT home, lag, round(r, 6) AS r, n FROM o WHERE q = 1""",
    "widest_week": f"""{_I}, f AS (SELECT home, time, stddev_samp("I") {_FRAME(168)} AS sd, count("I") {_FRAME(168)} AS n FROM idx),
o AS (SELECT *, row_number() OVER (PARTITION BY home ORDER BY round(sd, 6) DESC, time) AS q FROM f WHERE n >= 120) SELECT home, time, round(sd, 6) AS sd FROM o WHERE q = 1""",
    "pair_statistics": f"""{_G}, b AS (SELECT home, pm10 AS x, pm25 AS y, pm10 - pm25 AS d FROM grid WHERE pm10 IS NOT NULL AND pm25 IS NOT NULL), m AS (SELECT home, quantile_cont(d, 0.5) AS md FROM b GROUP BY home)
SELECT home, count(*) AS n, round(avg(d), 6) AS bias, round(any_value(md), 6) AS bias_median, round(stddev_samp(d), 6) AS bias_sd, round(corr(x, y), 6) AS pearson, round(regr_slope(y, x), 6) AS slope, round(quantile_cont(abs(d - md), 0.5), 6) AS mad FROM b JOIN m USING (home) GROUP BY home""",
    "humidity_absolute": f"""{_G}, h AS (SELECT home, 216.7 * (6.112 * exp(17.62 * t / (243.12 + t)) * rh / 100.0) / (t + 273.15) AS ah FROM grid WHERE t IS NOT NULL AND rh IS NOT NULL)
SELECT home, round(avg(ah), 6) AS ah_mean, round(max(ah), 6) AS ah_max FROM h GROUP BY home""",
    "rolling_correlation": f"""WITH {HOURLY}, f AS (SELECT home, count(*) OVER w AS n, corr(co2, t) OVER w AS r, round(stddev_samp(co2) OVER w, 9) = 0 OR round(stddev_samp(t) OVER w, 9) = 0 AS flat FROM readings WHERE co2 IS NOT NULL AND t IS NOT NULL WINDOW w AS (PARTITION BY home ORDER BY time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT home, count(*) AS n, round(avg(CASE WHEN flat THEN 0.0 ELSE r END), 5) AS mean_r, count_if(flat)::BIGINT AS n_flat FROM f WHERE n = 24 GROUP BY home""",
    "robust_scores": f"""WITH {HOURLY}, a AS (SELECT home, time, month(time)::INT AS month, co2, quantile_cont(co2, 0.5) OVER w AS m, count(co2) OVER w AS n FROM readings WHERE co2 IS NOT NULL WINDOW w AS (PARTITION BY home, month(time) ORDER BY time ROWS BETWEEN 24 PRECEDING AND 24 FOLLOWING)),
b AS (SELECT *, abs(co2 - m) AS d FROM a), c AS (SELECT *, quantile_cont(d, 0.5) OVER (PARTITION BY home, month ORDER BY time ROWS BETWEEN 24 PRECEDING AND 24 FOLLOWING) * 1.4826 AS mad FROM b),
s AS (SELECT *, CASE WHEN n >= 25 AND mad > 0 THEN d / mad END AS score FROM c)
SELECT home, month, count(score) AS n, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score, count_if(score > 1.5)::BIGINT AS n_high FROM s GROUP BY home, month""",
    "forecast_metrics": f"""{_I}, f AS (SELECT *, lead("I", 3) OVER (PARTITION BY home ORDER BY time) AS y, lead("class_I", 3) OVER (PARTITION BY home ORDER BY time) AS c, epoch(time)::BIGINT AS e,
 epoch(min(time) OVER (PARTITION BY home))::BIGINT AS a, epoch(max(time) OVER (PARTITION BY home))::BIGINT AS b FROM idx),
t AS (SELECT * FROM f WHERE e > a + floor((b - a) * 0.75) + 108000 AND "I" IS NOT NULL AND y IS NOT NULL), p AS (SELECT home, avg(abs(y - "I")) AS mae FROM t GROUP BY home),
k AS (SELECT count(*) AS n, count_if("class_I" = c)::DOUBLE AS hit, {', '.join(f'count_if("class_I" = {k})::DOUBLE AS a{k}, count_if(c = {k})::DOUBLE AS b{k}, count_if("class_I" = {k} AND c = {k})::DOUBLE AS t{k}' for k in range(5))} FROM t),
g AS (SELECT *, hit / n AS po, ({' + '.join(f'a{k} * b{k}' for k in range(5))}) / (n::DOUBLE * n) AS pe, ({' + '.join(f'CASE WHEN a{k} + b{k} = 0 THEN 0.0 ELSE 2 * t{k} / (a{k} + b{k}) END' for k in range(5))}) / 5 AS f1 FROM k)
SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa, round(f1, 6) AS macro_f1, (SELECT round(quantile_cont(mae, 0.5), 6) FROM p) AS mae_median, (SELECT round(quantile_cont(mae, 0.25), 6) FROM p) AS mae_q1, (SELECT round(quantile_cont(mae, 0.75), 6) FROM p) AS mae_q3 FROM g""",
}
