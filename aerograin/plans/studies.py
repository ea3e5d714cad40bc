"""Queries of the hourly studies: trailing means, pooled correlations, rule comparison, horizons, splits, online features, tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import INDICATORS
from ..functions import fuzzy, scores, stats
from ..operators import features
from . import hourly, sensor, sqltext

R = hourly.r6
FOLDS, INNER = 5, 3
MIN_COMMON = 200


def trailing_pm(spark, sf_dir):
    """PM means of the last 24 hours where at least 18 are present."""
    w = features.hours_back("home", "time", 24)
    x = hourly.grid(spark, sf_dir)
    return x.select("home", "time", *[F.round(F.when(F.count(c).over(w) >= 18, F.avg(c).over(w)), 6).alias(f"{c}_24h") for c in ("pm25", "pm10")])


def _pairs_long(g: DataFrame) -> DataFrame:
    pairs = ", ".join(f"'{a}-{b}', {a}, {b}" for a, b in hourly.PAIRS)
    return g.select("home", "season", F.expr(f"stack({len(hourly.PAIRS)}, {pairs}) as (pair, x, y)")).where("x is not null and y is not null")


def pooled_correlations(spark, sf_dir):
    """Per season and over all: median rank correlation over homes against the pooled one, flagged where they part."""
    long = _pairs_long(hourly.grid(spark, sf_dir))
    per = stats.spearman(long, ["home", "season", "pair"], "x", "y").where(F.col("n") >= MIN_COMMON)
    every = lambda df: df.withColumn("season", F.explode(F.array(F.lit("ALL"), "season")))
    med = every(per).groupBy("season", "pair").agg(F.count(F.lit(1)).alias("n_home_seasons"), F.countDistinct("home").alias("n_homes"), F.percentile("rho", 0.5).alias("median_rho"))
    pooled = stats.spearman(every(long), ["season", "pair"], "x", "y", "pooled_rho")
    both = pooled.join(med, ["season", "pair"])
    apart = (F.abs(F.col("pooled_rho") - F.col("median_rho")) > 0.2) | (F.signum("pooled_rho") != F.signum("median_rho"))
    return both.select("season", "pair", "n_home_seasons", "n_homes", F.col("n").alias("pooled_n"), *R("median_rho", "pooled_rho"), apart.alias("flag"))


def rule_comparison(spark, sf_dir):
    """Mean, maximum and index by season: class shares, hours more than a class better than the worst component, hours that
    hide a low or critical one, agreement and rank correlation with the index."""
    x = hourly.indexed(spark, sf_dir).where(scores.complete())
    rules = F.expr("stack(3, 'mean', Q_mean, 'max', Q_max, 'index', I) as (rule, score)")
    y = x.select("I", "class_I", "Q_max", F.explode(F.array(F.lit("ALL"), "season")).alias("season"), rules)
    y = y.withColumns({"c": scores.class_of_score(F.col("score")), "w": scores.class_of_score(F.col("Q_max"))})
    bad = F.col("w") >= 3
    agg = y.groupBy("rule", "season").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg((F.col("c") == k).cast("int")), 6).alias(f"share_{k}") for k in range(5)], F.round(F.avg((F.col("w") - F.col("c") > 1).cast("int")), 6).alias("share_much_better"), F.count_if(bad).alias("n_bad"), F.round(F.try_divide(F.count_if(bad & (F.col("c") <= 2)), F.count_if(bad)), 6).alias("share_hidden"), F.round(F.avg((F.col("c") == F.col("class_I")).cast("int")), 6).alias("agreement"))
    rho = stats.spearman(y, ["rule", "season"], "score", "I").select("rule", "season", F.round("rho", 6).alias("rho"))
    return agg.join(rho, ["rule", "season"])


def horizon_summary(spark, sf_dir):
    """Per series and horizon: medians over the homes with 200 pairs, and pooled errors of both naive forecasts on common hours."""
    x = features.targets(hourly.indexed(spark, sf_dir), ["I", "co2"])
    parts = ", ".join(f"'{c}', {h}, {c}, {c}__h{h}, {c}__h{h}_lag24" for c in ("I", "co2") for h in (1, 3, 6))
    long = x.select("home", F.expr(f"stack(6, {parts}) as (series, h, now, then, day)")).where("now is not null and then is not null")
    both = F.col("day").isNotNull()
    p, d = F.abs(F.col("then") - F.col("now")), F.abs(F.col("then") - F.col("day"))
    per = long.groupBy("series", "h", "home").agg(F.count(F.lit(1)).alias("n"), F.corr("now", "then").alias("r"), F.avg(F.when(both, p)).alias("mp"), F.avg(F.when(both, d)).alias("md"), F.sum(F.when(both, p)).alias("sp"), F.sum(F.when(both, d)).alias("sd"), F.count_if(both).alias("k")).where(F.col("n") >= MIN_COMMON)
    out = per.groupBy("series", "h").agg(F.count(F.lit(1)).alias("n_homes"), F.percentile("r", 0.5).alias("median_r"), F.percentile("r", 0.25).alias("q1_r"), F.percentile("r", 0.75).alias("q3_r"), F.percentile("mp", 0.5).alias("median_persistence"), F.percentile("md", 0.5).alias("median_day"), (F.sum("sp") / F.sum("k")).alias("pooled_persistence"), (F.sum("sd") / F.sum("k")).alias("pooled_day"))
    return out.select("series", "h", "n_homes", *R("median_r", "q1_r", "q3_r", "median_persistence", "median_day", "pooled_persistence", "pooled_day"))


def forecast_from_indicators(spark, sf_dir):
    """Indicators forecast three hours on (mean of now and the same hour a day before), the index computed from them: its error
    beside the index carried on, and how often its largest component is a dominant one (hours with an index over 25)."""
    x = features.targets(hourly.indexed(spark, sf_dir), [*INDICATORS, "I", "Q_A", "Q_V", "Q_M", "Q_max"], (3,))
    keep = ["home", "time", F.col("I").alias("I_now"), F.col("I__h3").alias("I_then"), *[F.col(f"Q_{c}__h3").alias(f"then_{c}") for c in "AVM"], F.col("Q_max__h3").alias("then_max")]
    y = x.select(*keep, *[((F.col(i) + F.col(f"{i}__h3_lag24")) / 2).alias(i) for i in INDICATORS])
    z = scores.with_index(y).where("I is not null and I_then is not null and I_now is not null")
    top = F.array_max(F.array(*[F.struct(F.round(f"Q_{c}", 9).alias("q"), F.lit(-k).alias("k"), F.col(f"then_{c}").alias("t")) for k, c in enumerate("AVM")]))["t"]
    hit = F.when(F.col("I_then") > 25, (top >= F.col("then_max") - 1.0).cast("int"))
    out = z.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("I") - F.col("I_then"))).alias("mae_b"), F.avg(F.abs(F.col("I_now") - F.col("I_then"))).alias("mae_persistence"), F.avg(hit).alias("dominant_match"), F.count(hit).alias("n_match"))
    return out.select("home", "n", *R("mae_b", "mae_persistence", "dominant_match"), "n_match")


def _grouped(df: DataFrame, groups: int) -> DataFrame:
    """home, grp: homes dealt to equal groups in the order of a hash."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    k = F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit("42:"), F.col("home").cast("string"))), "home")) - 1
    return df.select("home").distinct().select("home", F.floor(k * F.least(F.lit(groups), n) / n).cast("int").alias("grp"))  # one row a home


def unseen_homes(spark, sf_dir):
    """Split by unseen homes, horizon 3: a fold trains on other homes before each home's cut, and tests on its own after a gap."""
    g = hourly.grid(spark, sf_dir).join(F.broadcast(_grouped(hourly.grid(spark, sf_dir), FOLDS)), "home")
    w, s = Window.partitionBy("home"), features.seconds("time")
    cut = F.min(s).over(w) + 0.75 * (F.max(s).over(w) - F.min(s).over(w))
    g = g.withColumns({"early": s + 3 * 3600 < cut, "late": s >= cut + 27 * 3600})
    folds = g.select("grp").distinct().select(F.col("grp").alias("fold"))
    x = g.crossJoin(F.broadcast(folds))  # at most FOLDS rows
    return x.groupBy("fold").agg(F.count_if((F.col("grp") != F.col("fold")) & F.col("early")).alias("n_train"), F.count_if((F.col("grp") == F.col("fold")) & F.col("late")).alias("n_test"))


def inner_folds(spark, sf_dir):
    """Expanding folds of the pooled training rows in order of time: each of the last three quarters is validated in turn."""
    x = features.time_split(hourly.grid(spark, sf_dir)).where("part = 'train'")
    # Ranks by day first: a day's rows meet in one task, and the counts of the days before it are added.
    day = F.to_date("time")
    local = x.withColumn("day", day).withColumn("k", F.row_number().over(Window.partitionBy("day").orderBy("time", "home")) - 1)
    per = local.groupBy("day").agg(F.count(F.lit(1)).alias("c"))
    base = per.select("day", F.coalesce(F.sum("c").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("c").over(Window.partitionBy()).alias("n"))
    y = local.join(base, "day").withColumn("at", F.col("base") + F.col("k")).withColumn("size", F.floor(F.col("n") / (INNER + 1)))
    f = y.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(INNER - 1))))
    begin = F.col("n") - (INNER - F.col("fold")) * F.col("size")
    f = f.withColumns({"tr": F.col("at") < begin, "va": (F.col("at") >= begin) & (F.col("at") < begin + F.col("size"))})
    return f.groupBy("fold").agg(F.count_if("tr").alias("n_train"), F.count_if("va").alias("n_valid"), F.max(F.when(F.col("tr"), F.col("time"))).alias("last_train"), F.min(F.when(F.col("va"), F.col("time"))).alias("first_valid"))


def subsample_train(spark, sf_dir):
    """A tenth of the training rows of every home, by hash."""
    x = features.time_split(hourly.grid(spark, sf_dir)).where("part = 'train'")
    w = Window.partitionBy("home")
    draw = F.md5(F.concat_ws(":", F.lit("42"), F.col("home").cast("string"), features.seconds("time").cast("string")))
    y = x.withColumns({"r": F.row_number().over(w.orderBy(draw)), "n": F.count(F.lit(1)).over(w)}).where(F.col("r") <= F.round(0.1 * F.col("n")))
    return y.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last"), F.round(F.avg("co2"), 6).alias("mean_co2"))


def online_features(spark, sf_dir):
    """Features of each home's last eligible hour from its last 24 hours alone, and how far they are from the batch ones."""
    x = features.rolling(hourly.indexed(spark, sf_dir))
    names = [f"{i}_{s}_{w}h" for i in INDICATORS for w in features.WINDOWS for s in ("mean", "min", "max", "std")]
    last = x.where("eligible").groupBy("home").agg(F.max_by(F.struct("time", *names), "time").alias("b")).select("home", F.col("b.time").alias("at"), F.col("b").alias("batch"))
    h = hourly.indexed(spark, sf_dir).join(F.broadcast(last.select("home", "at")), "home")  # one row a home
    age = (features.seconds("at") - features.seconds("time")) / 3600
    h = h.withColumn("age", age).where("age >= 0 and age < 24")
    fn = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}
    online = h.groupBy("home").agg(*[fn[s](F.when(F.col("age") < w, F.col(i))).alias(f"{i}_{s}_{w}h") for i in INDICATORS for w in features.WINDOWS for s in fn])
    both = online.join(last, "home")
    gap = F.greatest(*[F.abs(F.col(n) - F.col(f"batch.{n}")) for n in names])
    return both.select("home", F.col("at").alias("time"), *R("co2_mean_24h", "co2_std_24h", "pm25_max_6h", "rh_min_3h"), (gap < 1e-6).alias("same"))


def fuzzy_hourly(spark, sf_dir):
    """The two-level fuzzy index of every complete hour, and its classes against those of the additive index."""
    x = hourly.indexed(spark, sf_dir).where(scores.complete()).select("home", "time", "class_I", F.col("pm25").alias("pm2_5"), "pm10", "co2", F.col("t").alias("temperature"), F.col("rh").alias("humidity"))
    sev = scores.severity(scores.output_class(F.round("index_value", 9)))
    return fuzzy.infer(x).withColumn("fuzzy", sev).groupBy("class_I").agg(*[F.count_if(F.col("fuzzy") == k).alias(f"f{k}") for k in range(4)], F.round(F.avg("index_value"), 5).alias("mean_index"))


def aligned_series(spark, sf_dir):
    """Every two homes' index on the hours that both have."""
    x = hourly.indexed(spark, sf_dir).where(scores.complete()).select("home", "time", "I")
    y = x.select(F.col("home").alias("home_b"), "time", F.col("I").alias("J"))
    return x.join(y, "time").where("home < home_b").groupBy("home", "home_b").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("I", "J"), 6).alias("r"))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of two tables that must hold each key once; a repeated key raises when the result is read."""
    bad = lambda df, side: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n_{side}"), F.first(F.struct(*df.columns)).alias(f"_{side}"))
    both = bad(left, "l").join(bad(right, "r"), keys)
    fine = F.when((F.col("_n_l") == 1) & (F.col("_n_r") == 1), F.lit(True)).otherwise(F.raise_error(F.lit("a key repeats in a one-to-one join")).cast("boolean"))
    return both.where(fine).select(*keys, *[F.col(f"_l.`{c}`").alias(c) for c in left.columns if c not in keys], *[F.col(f"_r.`{c}`").alias(c) for c in right.columns if c not in keys])


def features_with_targets(spark, sf_dir):
    """Eligible features joined one to one with the three-hour target."""
    x = features.rolling(hourly.indexed(spark, sf_dir)).where("eligible").select("home", "time", "co2_mean_24h")
    y = features.targets(hourly.indexed(spark, sf_dir), ["I"], (3,)).where("I__h3 is not null").select("home", "time", "I__h3")
    return one_to_one(x, y, ["home", "time"]).groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("co2_mean_24h", "I__h3"), 6).alias("r"))


def method_errors(spark, sf_dir):
    """Errors of three naive forecasts side by side (one pivot), and the best of each home, the first of equal ones."""
    x = features.targets(hourly.indexed(spark, sf_dir), ["I"], (3,)).where("I is not null and I__h3 is not null and I__h3_lag24 is not null")
    long = x.select("home", F.expr("stack(3, 'persistence', abs(I__h3 - I), 'day', abs(I__h3 - I__h3_lag24), 'mean', abs(I__h3 - (I + I__h3_lag24) / 2)) as (method, e)"))
    wide = long.groupBy("home").pivot("method", ["persistence", "day", "mean"]).agg(F.round(F.avg("e"), 6))
    best = F.array_min(F.array(*[F.struct(F.col(m).alias("e"), F.lit(k).alias("k"), F.lit(m).alias("m")) for k, m in enumerate(("persistence", "day", "mean"))]))["m"]
    return wide.withColumn("best", best)


def paired_forecast_tests(spark, sf_dir):
    """Persistence against the same hour of the day before, per series and horizon: signed ranks of the homes' errors, exact
    McNemar on hours more than 10 off, Holm over all of them."""
    x = features.targets(hourly.indexed(spark, sf_dir), ["I", "co2"])
    parts = ", ".join(f"'{c}', {h}, {c}, {c}__h{h}, {c}__h{h}_lag24" for c in ("I", "co2") for h in (1, 3, 6))
    long = x.select("home", F.expr(f"stack(6, {parts}) as (series, h, now, then, day)")).where("now is not null and then is not null and day is not null")
    a, b = F.abs(F.col("then") - F.col("now")), F.abs(F.col("then") - F.col("day"))
    per = long.groupBy("series", "h", "home").agg((F.avg(a) - F.avg(b)).alias("d"), F.count_if((a > 10) & (b <= 10)).alias("only_a"), F.count_if((a <= 10) & (b > 10)).alias("only_b"))
    ranks = stats.signed_ranks(per, ["series", "h"], "d")
    n = per.groupBy("series", "h").agg(F.sum("only_a").alias("only_a"), F.sum("only_b").alias("only_b"), F.count_if(F.col("d") < 0).alias("n_first_better"))
    both = ranks.join(n, ["series", "h"]).withColumn("p_mcnemar", stats.mcnemar_p(F.col("only_a"), F.col("only_b")))
    out = stats.holm(both.withColumn("one", F.lit(1)), ["one"], "p_wilcoxon")
    return out.select("series", "h", "n", F.round("statistic", 6).alias("statistic"), F.round("p_wilcoxon", 6).alias("p_wilcoxon"), F.round("p_holm", 6).alias("p_holm"), "only_a", "only_b", F.round("p_mcnemar", 6).alias("p_mcnemar"), "n_first_better")


def resource_totals(spark, sf_dir):
    """Totals per method of a table of runs: here event types with their values as seconds."""
    e = sensor.table(spark, sf_dir, "events")
    g = e.groupBy(F.col("event_type").alias("method")).agg(F.count(F.lit(1)).alias("n_units"), F.sum("value").alias("total"), F.avg("value").alias("mean_s"), F.max("value").alias("max_s"))
    return g.select("method", "n_units", *R("total", "mean_s", "max_s"), F.round(F.col("total") / F.sum("total").over(Window.partitionBy()), 6).alias("share"))


QUERIES = {f.__name__: f for f in (trailing_pm, pooled_correlations, rule_comparison, horizon_summary, forecast_from_indicators, unseen_homes, inner_folds, subsample_train, online_features, fuzzy_hourly, aligned_series, features_with_targets, method_errors, paired_forecast_tests, resource_totals)}

_G, _I = f"WITH {sqltext.GRID}", f"WITH {sqltext.GRID}, {sqltext.index()}"
_DAY = "OVER (PARTITION BY home ORDER BY epoch(time)::BIGINT RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)"
_LONG = " UNION ALL ".join(f"SELECT home, season, '{a}-{b}' AS pair, {a} AS x, {b} AS y FROM grid WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in hourly.PAIRS)
_RANK = lambda c, keys: f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0"
_ONE = lambda c, h: f"""SELECT home, time, '{c}' AS series, {h} AS h, "{c}" AS now, lead("{c}", {h}) OVER (PARTITION BY home ORDER BY time) AS "then", lag("{c}", {24 - h}) OVER (PARTITION BY home ORDER BY time) AS day FROM idx"""
_SERIES = " UNION ALL ".join(_ONE(c, h) for c in ("I", "co2") for h in (1, 3, 6))
_CLASS = lambda c: f"greatest(0, least(4, ceil({c} / 25.0::DOUBLE)::INTEGER))"
_SPAN = "span AS (SELECT home, min(epoch(time))::BIGINT AS a, max(epoch(time))::BIGINT AS b FROM grid GROUP BY home)"
_TRAIN = f"{_SPAN}, train AS (SELECT g.* FROM grid g JOIN span USING (home) WHERE epoch(time)::BIGINT <= a + floor((b - a) * 0.75))"


def _exact_p() -> str:
    """Two-sided p of the smaller rank sum t of n ranks, every set of ranks listed (n up to 12)."""
    return "(SELECT least(1.0, 2.0 * count_if(list_sum(list_transform(range(1, (n + 1)::BIGINT), lambda i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN i ELSE 0 END)) <= t) / count(*)) FROM (SELECT unnest(range(0, (1 << n::INTEGER)::BIGINT)) AS mask))"


SQL = {
    "trailing_pm": f"{_G} SELECT home, time, {', '.join(f'CASE WHEN count({c}) {_DAY} >= 18 THEN round(avg({c}) {_DAY}, 6) END AS {c}_24h' for c in ('pm25', 'pm10'))} FROM grid",
    "pooled_correlations": f"""{_G}, l AS ({_LONG}), a AS (SELECT *, {_RANK('x', 'home, season, pair')} AS rx, {_RANK('y', 'home, season, pair')} AS ry FROM l),
p AS (SELECT home, season, pair, corr(rx, ry) AS rho FROM a GROUP BY ALL HAVING count(*) >= 200), p2 AS (SELECT * FROM p UNION ALL SELECT home, 'ALL', pair, rho FROM p),
m AS (SELECT season, pair, count(*) AS n_home_seasons, count(DISTINCT home) AS n_homes, median(rho) AS median_rho FROM p2 GROUP BY ALL),
l2 AS (SELECT season, pair, x, y FROM l UNION ALL SELECT 'ALL', pair, x, y FROM l), b AS (SELECT *, {_RANK('x', 'season, pair')} AS rx, {_RANK('y', 'season, pair')} AS ry FROM l2),
q AS (SELECT season, pair, count(*) AS pooled_n, corr(rx, ry) AS pooled_rho FROM b GROUP BY ALL)
SELECT season, pair, n_home_seasons, n_homes, pooled_n, round(median_rho, 6) AS median_rho, round(pooled_rho, 6) AS pooled_rho, abs(pooled_rho - median_rho) > 0.2 OR sign(pooled_rho) <> sign(median_rho) AS flag FROM q JOIN m USING (season, pair)""",
    "rule_comparison": f"""{_I}, x AS (SELECT * FROM idx WHERE "I" IS NOT NULL), r AS ({' UNION ALL '.join(f"SELECT '{n}' AS rule, season, {c} AS score, \"I\", \"class_I\", \"Q_max\" FROM x" for n, c in (('mean', '"Q_mean"'), ('max', '"Q_max"'), ('index', '"I"')))}),
y AS (SELECT * FROM r UNION ALL SELECT rule, 'ALL', score, "I", "class_I", "Q_max" FROM r), z AS (SELECT *, {_CLASS('score')} AS c, {_CLASS('"Q_max"')} AS w, {_RANK('score', 'rule, season')} AS rx, {_RANK('"I"', 'rule, season')} AS ry FROM y)
SELECT rule, season, count(*) AS n, {', '.join(f'round(avg((c = {k})::INT), 6) AS share_{k}' for k in range(5))}, round(avg((w - c > 1)::INT), 6) AS share_much_better, count_if(w >= 3)::BIGINT AS n_bad,
 round(count_if(w >= 3 AND c <= 2) / nullif(count_if(w >= 3), 0), 6) AS share_hidden, round(avg((c = "class_I")::INT), 6) AS agreement, round(corr(rx, ry), 6) AS rho FROM z GROUP BY rule, season""",
    "horizon_summary": f"""{_I}, l AS ({_SERIES}), o AS (SELECT *, abs("then" - now) AS p, abs("then" - day) AS d FROM l WHERE now IS NOT NULL AND "then" IS NOT NULL),
h AS (SELECT series, h, home, corr(now, "then") AS r, avg(p) FILTER (day IS NOT NULL) AS mp, avg(d) AS md, sum(p) FILTER (day IS NOT NULL) AS sp, sum(d) AS sd, count(day) AS k FROM o GROUP BY ALL HAVING count(*) >= 200)
SELECT series, h, count(*) AS n_homes, round(median(r), 6) AS median_r, round(quantile_cont(r, 0.25), 6) AS q1_r, round(quantile_cont(r, 0.75), 6) AS q3_r, round(median(mp), 6) AS median_persistence, round(median(md), 6) AS median_day,
 round(sum(sp) / sum(k), 6) AS pooled_persistence, round(sum(sd) / sum(k), 6) AS pooled_day FROM h GROUP BY series, h""",
    "forecast_from_indicators": f"""{_I}, f AS (SELECT home, time, "I" AS i_now, lead("I", 3) OVER w AS i_then, {', '.join(f'lead("Q_{c}", 3) OVER w AS then_{c}' for c in ('A', 'V', 'M', 'max'))}, {', '.join(f'({i} + lag({i}, 21) OVER w) / 2 AS {i}' for i in INDICATORS)} FROM idx WINDOW w AS (PARTITION BY home ORDER BY time)),
{sqltext.index(None, 'fx', 'f')}, z AS (SELECT *, round("Q_A", 9) AS qa, round("Q_V", 9) AS qv, round("Q_M", 9) AS qm FROM fx WHERE "I" IS NOT NULL AND i_then IS NOT NULL AND i_now IS NOT NULL),
t AS (SELECT *, CASE WHEN i_then > 25 THEN (CASE WHEN qa >= qv AND qa >= qm THEN "then_A" WHEN qv >= qm THEN "then_V" ELSE "then_M" END >= then_max - 1.0)::INT END AS hit FROM z)
SELECT home, count(*) AS n, round(avg(abs("I" - i_then)), 6) AS mae_b, round(avg(abs(i_now - i_then)), 6) AS mae_persistence, round(avg(hit), 6) AS dominant_match, count(hit) AS n_match FROM t GROUP BY home""",
    "unseen_homes": f"""{_G}, hm AS (SELECT DISTINCT home FROM grid), gr AS (SELECT home, floor((row_number() OVER (ORDER BY md5('42:' || home), home) - 1) * least({FOLDS}, count(*) OVER ()) / (count(*) OVER ()))::INT AS grp FROM hm), {_SPAN},
x AS (SELECT grp, epoch(time)::BIGINT + 10800 < a + 0.75 * (b - a) AS early, epoch(time)::BIGINT >= a + 0.75 * (b - a) + 97200 AS late FROM grid JOIN gr USING (home) JOIN span USING (home))
SELECT f.grp AS fold, count_if(x.grp <> f.grp AND early)::BIGINT AS n_train, count_if(x.grp = f.grp AND late)::BIGINT AS n_test FROM x CROSS JOIN (SELECT DISTINCT grp FROM gr) f GROUP BY f.grp""",
    "inner_folds": f"""{_G}, {_TRAIN}, k AS (SELECT *, row_number() OVER (ORDER BY time, home) - 1 AS p, count(*) OVER () AS n FROM train), f AS (SELECT *, n // {INNER + 1} AS size, unnest(range({INNER}))::INT AS fold FROM k),
g AS (SELECT *, n - ({INNER} - fold) * size AS s FROM f) SELECT fold, count_if(p < s)::BIGINT AS n_train, count_if(p >= s AND p < s + size)::BIGINT AS n_valid, max(time) FILTER (p < s) AS last_train, min(time) FILTER (p >= s AND p < s + size) AS first_valid FROM g GROUP BY fold""",
    "subsample_train": f"""{_G}, {_TRAIN}, k AS (SELECT *, row_number() OVER (PARTITION BY home ORDER BY md5('42:' || home || ':' || epoch(time)::BIGINT)) AS r, count(*) OVER (PARTITION BY home) AS n FROM train)
SELECT home, count(*) AS n, min(time) AS first, max(time) AS last, round(avg(co2), 6) AS mean_co2 FROM k WHERE r <= round(0.1 * n) GROUP BY home""",
    "online_features": f"""{_I}, c AS (SELECT home, time, "I", {', '.join(f'count({i}) OVER (PARTITION BY home ORDER BY epoch(time)::BIGINT RANGE BETWEEN {w * 3600 - 1} PRECEDING AND CURRENT ROW) / {w}.0 >= 0.8 AS k_{i}_{w}' for i in INDICATORS for w in features.WINDOWS)},
 {', '.join(f'{i} - lag({i}) OVER (PARTITION BY home ORDER BY time) IS NOT NULL AS d_{i}_ok' for i in INDICATORS)} FROM idx),
e AS (SELECT home, max(time) AS at_ FROM c WHERE "I" IS NOT NULL AND {' AND '.join(f'k_{i}_{w}' for i in INDICATORS for w in features.WINDOWS)} AND {' AND '.join(f'd_{i}_ok' for i in INDICATORS)} GROUP BY home),
h AS (SELECT g.*, at_, date_diff('hour', time, at_) AS age FROM grid g JOIN e USING (home) WHERE time <= at_ AND date_diff('hour', time, at_) < 24)
SELECT home, at_ AS time, round(avg(co2), 6) AS co2_mean_24h, round(stddev_samp(co2), 6) AS co2_std_24h, round(max(pm25) FILTER (age < 6), 6) AS pm25_max_6h, round(min(rh) FILTER (age < 3), 6) AS rh_min_3h, true AS same FROM h GROUP BY home, at_""",
    "fuzzy_hourly": f"""{_I}, src AS (SELECT home, time, "class_I", pm25 AS pm2_5, pm10, co2, t AS temperature, rh AS humidity FROM idx WHERE "I" IS NOT NULL), {sensor.fuzzy_ctes('src', 'home, time')}
SELECT "class_I", {', '.join(f'count_if({sensor.sev_sql("index_value")} = {k})::BIGINT AS f{k}' for k in range(4))}, round(avg(index_value), 5) AS mean_index FROM hf GROUP BY "class_I\"""",
    "aligned_series": f"""{_I} SELECT a.home, b.home AS home_b, count(*) AS n, round(corr(a."I", b."I"), 6) AS r FROM idx a JOIN idx b ON a.time = b.time AND a.home < b.home WHERE a."I" IS NOT NULL AND b."I" IS NOT NULL GROUP BY a.home, b.home""",
    "method_errors": f"""{_I}, l AS ({_ONE('I', 3)}), e AS (SELECT home, round(avg(abs("then" - now)), 6) AS persistence, round(avg(abs("then" - day)), 6) AS day, round(avg(abs("then" - (now + day) / 2)), 6) AS mean FROM l WHERE now IS NOT NULL AND "then" IS NOT NULL AND day IS NOT NULL GROUP BY home)
SELECT *, CASE WHEN persistence <= day AND persistence <= mean THEN 'persistence' WHEN day <= mean THEN 'day' ELSE 'mean' END AS best FROM e""",
    "paired_forecast_tests": f"""{_I}, l AS ({_SERIES}), o AS (SELECT *, abs("then" - now) AS a, abs("then" - day) AS b FROM l WHERE now IS NOT NULL AND "then" IS NOT NULL AND day IS NOT NULL),
p AS (SELECT series, h, home, avg(a) - avg(b) AS d, count_if(a > 10 AND b <= 10) AS oa, count_if(a <= 10 AND b > 10) AS ob FROM o GROUP BY ALL), k AS (SELECT *, rank() OVER (PARTITION BY series, h ORDER BY abs(d)) AS r FROM p),
s AS (SELECT series, h, count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS t0, sum(oa)::BIGINT AS only_a, sum(ob)::BIGINT AS only_b, count_if(d < 0)::BIGINT AS n_first_better FROM k GROUP BY ALL),
s1 AS (SELECT *, coalesce(t0, 0)::DOUBLE AS t FROM s), s2 AS (SELECT *, {_exact_p()} AS pw,
 CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))) END AS pm FROM s1),
g AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY pw) + 1) * pw) AS raw, row_number() OVER (ORDER BY pw) AS i FROM s2)
SELECT series, h, n, round(t, 6) AS statistic, round(pw, 6) AS p_wilcoxon, round(max(raw) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS p_holm, only_a, only_b, round(pm, 6) AS p_mcnemar, n_first_better FROM g""",
    "resource_totals": "SELECT event_type AS method, count(*) AS n_units, round(sum(value), 6) AS total, round(avg(value), 6) AS mean_s, round(max(value), 6) AS max_s, round(sum(value) / sum(sum(value)) OVER (), 6) AS share FROM events GROUP BY event_type",
}
SQL["features_with_targets"] = SQL["online_features"][: SQL["online_features"].index("e AS (SELECT home, max(time)")] + f"""e AS (SELECT home, time FROM c WHERE "I" IS NOT NULL AND {' AND '.join(f'k_{i}_{w}' for i in INDICATORS for w in features.WINDOWS)} AND {' AND '.join(f'd_{i}_ok' for i in INDICATORS)}),
f AS (SELECT home, time, avg(co2) {_DAY} AS m, lead("I", 3) OVER (PARTITION BY home ORDER BY time) AS y FROM idx)
SELECT home, count(*) AS n, round(corr(m, y), 6) AS r FROM f JOIN e USING (home, time) WHERE y IS NOT NULL GROUP BY home"""
