"""Experiments on the index: grids, boundary sweeps, fault scenarios, calibration, perturbation trials."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CHANNELS, FuzzyConfig, QualityConfig
from ..functions import fuzzy, scores
from . import quality, sequence

REASONS = ("single_spike", "stuck_value", "data_loss", "gradual_drift", "out_of_range")
PROFILES = {  # fixed values: temperature edges of each room and season
    "kitchen_cold": (15.5, 16.5, 18.0, 21.0, 22.5, 23.5),
    "general_warm": (22.0, 23.0, 23.5, 25.5, 26.0, 27.0),
    "kitchen_warm": (18.0, 20.0, 21.0, 25.5, 26.0, 27.0),
}
#: Per channel: base, swing, spikes, out-of-range value, stuck value, drift step, size of a real event (None: none). Fixed values.
SCENARIOS = {
    "co2": (700.0, 10.0, (400.0, 120.0), 999999.0, 705.0, 35.0, 300.0),
    "temperature": (20.0, 0.3, (8.0, 2.5), 200.0, 20.2, 0.4, 4.0),
    "humidity": (45.0, 2.0, (35.0, 15.0), 150.0, 46.0, 3.0, 25.0),
    "pm10": (6.0, 0.3, (40.0,), 99999.0, 6.5, 8.0, None),
}
POINTS = 40


def line(spark: SparkSession, n: int, lo: float, hi: float, name: str) -> DataFrame:
    """n evenly spaced values, ends included."""
    return spark.range(n).select((F.lit(lo) + F.col("id") * ((hi - lo) / (n - 1))).alias(name))


def score_methods(df: DataFrame) -> DataFrame:
    """From component scores a, v, m (0 to 100): two_level, fuzzy_max, crisp_max, mean and their severities."""
    shapes = fuzzy.monotonic_shapes(*FuzzyConfig().output)
    act = fuzzy.activation([fuzzy.memberships(F.col(c), shapes) for c in ("a", "v", "m")])
    out = fuzzy.with_centroid(df.withColumns({f"o{s}": act[s] for s in range(4)}), [f"o{s}" for s in range(4)], "two_level").drop("o0", "o1", "o2", "o3")
    sev = lambda c: scores.severity(scores.output_class(F.round(c, 9)))
    top = F.greatest("a", "v", "m")
    out = out.withColumns({"fuzzy_max": top, "crisp_max": sev(top) * 25.0 + 12.5, "mean": (F.col("a") + F.col("v") + F.col("m")) / 3})
    return out.withColumns({f"sev_{c}": sev(F.col(c)) for c in ("two_level", "fuzzy_max", "crisp_max", "mean")})


def cube(spark: SparkSession, n: int) -> DataFrame:
    """All n^3 triples of component scores on an even grid."""
    return line(spark, n, 0.0, 100.0, "a").crossJoin(line(spark, n, 0.0, 100.0, "v")).crossJoin(line(spark, n, 0.0, 100.0, "m"))


def pair_differences(df: DataFrame, methods: tuple[str, ...] = ("two_level", "fuzzy_max", "crisp_max", "mean")) -> DataFrame:
    """method_a, method_b: n, mean, median, p95, max absolute difference, signed mean, class agreement. One pass, pairs stacked."""
    pairs = [(a, b) for i, a in enumerate(methods) for b in methods[i + 1 :]]
    rows = ", ".join(f"'{a}', '{b}', {a}, {b}, sev_{a}, sev_{b}" for a, b in pairs)
    long = df.select(F.expr(f"stack({len(pairs)}, {rows}) as (method_a, method_b, x, y, sx, sy)")).withColumn("d", F.abs(F.col("x") - F.col("y")))
    return long.groupBy("method_a", "method_b").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_abs"), F.percentile("d", 0.5).alias("median_abs"), F.percentile("d", 0.95).alias("p95_abs"), F.max("d").alias("max_abs"), F.avg(F.col("x") - F.col("y")).alias("signed"), F.avg((F.col("sx") == F.col("sy")).cast("int")).alias("agreement"))


def boundaries(cfg: FuzzyConfig | None = None) -> list[tuple[str, str, str, float]]:
    """(id, channel, profile, value) of the 33 class boundaries: three per one-sided channel, six per two-sided one and profile."""
    cfg = cfg or FuzzyConfig()
    out = [(f"{c}_{i}", c, "kitchen_cold", b) for c in ("pm2_5", "pm10", "co2") for i, b in enumerate(getattr(cfg, c)[0])]
    names = ("critical_low", "acceptable_low", "favourable_low", "favourable_high", "acceptable_high", "critical_high")
    edges = lambda e: (e[0], e[2], e[2], e[3], e[3], e[5])  # noqa: E731  the inner edges are listed twice, as the method has them
    out += [(f"humidity_{n}", "humidity", "kitchen_cold", v) for n, v in zip(names, edges(cfg.humidity[0]), strict=True)]
    for p, e in PROFILES.items():
        out += [(f"temperature_{n}_{p}", "temperature", p, v) for n, v in zip(names, edges(e), strict=True)]
    return out


def contexts(cfg: FuzzyConfig, profile: str) -> dict[str, dict[str, float]]:
    """Representative values of all inputs in three settings."""
    out = {}
    for k, name in enumerate(("favourable", "acceptable", "degraded")):
        one = lambda b, k=k: (b[0] / 2, (b[0] + b[1]) / 2, (b[1] + b[2]) / 2)[k]
        two = lambda e, k=k: ((e[2] + e[3]) / 2, (e[3] + e[4]) / 2, (e[4] + e[5]) / 2)[k]
        out[name] = {"pm2_5": one(cfg.pm2_5[0]), "pm10": one(cfg.pm10[0]), "co2": one(cfg.co2[0]), "humidity": two(cfg.humidity[0]), "temperature": two(PROFILES[profile])}
    return out


def sweeps(spark: SparkSession, points: int = 21) -> DataFrame:
    """boundary, channel, profile, context, i, input and the five inputs: every boundary in every context, swept over its
    channel's uncertainty. The list of boundaries is a literal table of 33 x 3 rows."""
    cfg = FuzzyConfig()
    rows = []
    for b, channel, profile, value in boundaries(cfg):
        for context, at in contexts(cfg, profile).items():
            rows.append((b, channel, profile, context, value, CHANNELS[channel][2], *(at[c] for c in ("pm2_5", "pm10", "co2", "temperature", "humidity"))))
    base = spark.createDataFrame(rows, "boundary string, channel string, profile string, context string, at double, span double, pm2_5 double, pm10 double, co2 double, temperature double, humidity double")
    x = base.crossJoin(spark.range(points).select(F.col("id").cast("int").alias("i"))).withColumn("input", F.col("at") - F.col("span") + F.col("i") * 2 * F.col("span") / (points - 1))
    return x.withColumns({c: F.when(F.col("channel") == c, F.col("input")).otherwise(F.col(c)) for c in ("pm2_5", "pm10", "co2", "temperature", "humidity")})


def swept(spark: SparkSession, points: int = 21) -> DataFrame:
    """sweeps() with the index and baselines of every point, under each point's own temperature profile."""
    from ..plans.sensor import with_baselines

    x, out = sweeps(spark, points), None
    for p, e in PROFILES.items():
        cfg = FuzzyConfig(temperature=(e, 0.5))
        y = with_baselines(fuzzy.infer(x.where(F.col("profile") == p), cfg), cfg)
        out = y if out is None else out.unionByName(y)
    return out


def continuity(df: DataFrame) -> DataFrame:
    """boundary, context, method: jumps between neighbours (max, mean, median, p95, sum), steepest ratio, class changes, range,
    drops where more should never be better, and the area between the index and the fuzzy maximum."""
    rows = "stack(4, 'TWO_LEVEL', index_value, sev_two_level, 'FUZZY_MAX', fuzzy_max, sev_fmax, 'CRISP_MAX', crisp_value, crisp, 'MEAN', weighted_mean, sev_mean) as (method, y, sev)"
    keys = ["boundary", "channel", "context", "method"]
    long = df.select("boundary", "channel", "context", "i", "input", F.abs(F.col("index_value") - F.col("fuzzy_max")).alias("apart"), F.expr(rows))
    w = Window.partitionBy(*keys).orderBy("i")
    s = long.withColumns({"dy": F.col("y") - F.lag("y").over(w), "dx": F.col("input") - F.lag("input").over(w), "turn": F.col("sev") != F.lag("sev").over(w), "trap": (F.col("apart") + F.lag("apart").over(w)) / 2 * (F.col("input") - F.lag("input").over(w))})
    j = F.abs("dy")
    one_sided = F.col("channel").isin("pm2_5", "pm10", "co2")
    return s.groupBy(*keys).agg(F.max(j).alias("max_jump"), F.avg(j).alias("mean_jump"), F.percentile(j, 0.5).alias("median_jump"), F.percentile(j, 0.95).alias("p95_jump"), F.sum(j).alias("variation"), F.max(F.try_divide(j, F.col("dx"))).alias("steepest"), F.count_if("turn").alias("n_changes"), (F.max("y") - F.min("y")).alias("spread"), F.count_if(one_sided & (F.col("dy") < -1e-9)).alias("n_drops"), F.sum("trap").alias("_area")).withColumn("area", F.when(F.col("method") == "TWO_LEVEL", F.col("_area"))).drop("_area")


def smoother(summary: DataFrame, base: str) -> DataFrame:
    """Whether the index jumps less than a baseline, boundary by boundary: counts of smoother, rougher, tied (1e-9)."""
    wide = summary.where(F.col("method").isin("TWO_LEVEL", base)).groupBy("boundary", "context").pivot("method", ["TWO_LEVEL", base]).agg(F.first("max_jump"))
    d = F.col("TWO_LEVEL") - F.col(base)
    return wide.agg(F.lit(base).alias("baseline"), F.count_if(d < -1e-9).alias("n_smoother"), F.count_if(d > 1e-9).alias("n_rougher"), F.count_if(F.abs(d) <= 1e-9).alias("n_tied"))


def scenario_kinds() -> list[tuple[str, str, int, float, float]]:
    """(channel, kind, variant 0 or 1, size, size2) of every fault scenario."""
    out = []
    for c, (_, _, spikes, oor, stuck, drift, event) in SCENARIOS.items():
        for variant in (0, 1):
            out += [(c, f"single_spike{'_alt' if k else ''}", variant, s, 0.0) for k, s in enumerate(spikes)]
            out += [(c, "out_of_range", variant, oor, 0.0), (c, "stuck_value", variant, stuck, 0.0), (c, "data_loss", variant, 0.0, 0.0), (c, "gradual_drift", variant, drift, 0.0)]
            if event is not None:
                out += [(c, "genuine_rapid_event", variant, event, 0.0), (c, "persistent_real_change", variant, event, 0.0)]
    return out


def scenarios(spark: SparkSession) -> DataFrame:
    """scenario_id, split, channel, i, slot, value, secondary, truth: closed forms over (scenario, i)."""
    rows = [(c, k, v, s, *SCENARIOS[c][:2]) for c, k, v, s, _ in scenario_kinds()]
    d = spark.createDataFrame(rows, "channel string, kind string, variant int, size double, base double, swing double")
    x = d.crossJoin(spark.range(POINTS).select(F.col("id").cast("int").alias("i")))
    i, h = F.col("i"), POINTS // 2
    scale = F.when(F.col("variant") == 0, 1.0).otherwise(1.15)
    calm = F.col("base") + F.col("swing") * F.sin(2 * math.pi * (i + F.when(F.col("variant") == 0, 0).otherwise(3)) / 7.0)
    ripple = lambda step, phase=0.0: 0.3 * F.col("swing") * F.sin(2 * math.pi * step / 5.0 + phase)
    kind, size = F.col("kind"), F.col("size")
    spike = kind.startswith("single_spike")
    value = (
        F.when(spike & (i == h), F.col("base") + size * scale)
        .when((kind == "out_of_range") & (i == h), size)
        .when((kind == "stuck_value") & i.between(h, h + 7), size)
        .when((kind == "data_loss") & i.between(h, h + 4), F.lit(None).cast("double"))
        .when((kind == "gradual_drift") & i.between(h, h + 9), F.col("base") + size * scale * (i - h + 1))
        .when((kind == "genuine_rapid_event") & (i >= h), F.col("base") + size * scale + ripple(i - h))
        .when((kind == "persistent_real_change") & (i >= h), F.col("base") + F.least(size * scale * 2 / 3, size * scale / 10 * (i - h + 1)) + ripple(i - h))
        .otherwise(calm)
    )
    truth = (
        F.when(spike & (i == h), "single_spike")
        .when((kind == "out_of_range") & (i == h), "out_of_range")
        .when((kind == "stuck_value") & i.between(h, h + 7), "stuck_value")
        .when((kind == "data_loss") & i.between(h, h + 4), "data_loss")
        .when((kind == "gradual_drift") & i.between(h, h + 9), "gradual_drift")
        .when(kind.isin("genuine_rapid_event", "persistent_real_change") & (i >= h), "genuine_event")
    )
    split = F.when(F.col("variant") == 0, "calibration").otherwise("validation")
    out = x.withColumns({"value": value, "truth": truth, "split": split})
    out = out.withColumn("scenario_id", F.concat_ws("_", "channel", "kind", "split"))
    return out.withColumn("secondary", F.when(F.col("channel").isin("temperature", "humidity"), F.col("value") + ripple(i, 1.7))).select("scenario_id", "split", "channel", "kind", "i", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, cast(i * 30 as decimal(18,6)))").alias("slot"), "value", "secondary", "truth")


def benchmark(spark: SparkSession, cfg: QualityConfig | None = None) -> DataFrame:
    """scenarios() through the hard and soft checks: adds state, usable, confirmed, reasons."""
    x = scenarios(spark)
    h = quality.hard(F.col("channel"), F.col("value"), F.col("value").isNotNull(), F.lit("ok"), F.lit(True))
    x = x.withColumns({"state": h["state"], "reason": h["reason"], "aux": F.lit(None).cast("array<double>"), "trend": F.lit(None).cast("double")})
    return quality.soft(x, ["scenario_id"], "slot", cfg or QualityConfig())


def detection_metrics(df: DataFrame, hit: Column, keys: list[str]) -> DataFrame:
    """Per reason: tp, fp, fn, tn, precision, recall, f1, fpr, specificity (null where undefined). `hit` reads `code`."""
    x = df.withColumn("code", F.explode(F.array(*[F.lit(r) for r in REASONS]))).withColumns({"p": hit, "t": F.coalesce(F.col("truth") == F.col("code"), F.lit(False))})
    c = x.groupBy(*keys, "code").agg(*[F.count_if(e).alias(n) for n, e in (("tp", F.col("p") & F.col("t")), ("fp", F.col("p") & ~F.col("t")), ("fn", ~F.col("p") & F.col("t")), ("tn", ~F.col("p") & ~F.col("t")))])
    c = c.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "fpr": F.try_divide("fp", F.col("fp") + F.col("tn"))})
    f1 = F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return c.withColumns({"f1": f1, "specificity": 1 - F.col("fpr")})


def match_events(df: DataFrame, tolerance: int = 2) -> DataFrame:
    """split, code: true events, found ones, predicted stretches that match none. At most one true event stands in a scenario;
    the predicted stretch nearest in start takes it."""
    x = df.withColumn("code", F.explode(F.array(*[F.lit(r) for r in REASONS]))).withColumn("p", F.array_contains("reasons", F.col("code")))
    true = x.where(F.col("truth") == F.col("code")).groupBy("split", "code", "scenario_id").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    w = Window.partitionBy("scenario_id", "code").orderBy("i")
    hits = x.where("p").withColumn("new", F.when(F.col("i") - F.lag("i").over(w) <= tolerance + 1, 0).otherwise(1)).withColumn("g", F.sum("new").over(w))
    pred = hits.groupBy("split", "code", "scenario_id", "g").agg(F.min("i").alias("pa"), F.max("i").alias("pb"))
    both = true.join(pred, ["split", "code", "scenario_id"]).where((F.col("pa") <= F.col("b") + tolerance) & (F.col("pb") >= F.col("a") - tolerance))
    first = both.withColumn("r", F.row_number().over(Window.partitionBy("split", "code", "scenario_id").orderBy(F.abs(F.col("pa") - F.col("a")), "pa"))).where("r = 1")
    n = true.groupBy("split", "code").agg(F.count(F.lit(1)).alias("n_true"))
    f = first.groupBy("split", "code").agg(F.count(F.lit(1)).alias("n_found"), F.avg(F.col("pa") - F.col("a")).alias("mean_delay"))
    p = pred.groupBy("split", "code").agg(F.count(F.lit(1)).alias("n_predicted"))
    return n.join(f, ["split", "code"], "full").join(p, ["split", "code"], "full").na.fill(0, ["n_true", "n_found", "n_predicted"])


def calibrate_hampel(spark: SparkSession, windows: tuple[int, ...] = (7, 11, 15), ks: tuple[float, ...] = (2.5, 3.0, 3.5)) -> DataFrame:
    """split, window, k: spike recall, false-positive rate, share of real events kept, objective. One frame pass a window."""
    x = scenarios(spark).where("channel = 'co2'").where(F.col("kind").startswith("single_spike") | F.col("kind").isin("genuine_rapid_event", "persistent_real_change"))
    out = None
    for n in windows:
        y = quality.with_hampel(x, ["scenario_id"], "slot", "value", n, 0.0).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
        d = F.abs(F.col("value") - F.col("hampel_median"))
        y = y.withColumn("flag", F.coalesce(F.when(F.col("hampel_mad") > 0, d > F.col("k") * F.col("hampel_mad")).otherwise(F.col("value") != F.col("hampel_median")), F.lit(False)))
        spike, event = F.coalesce(F.col("truth") == "single_spike", F.lit(False)), F.coalesce(F.col("truth") == "genuine_event", F.lit(False))
        z = y.groupBy("split", "k").agg(F.lit(n).alias("window"), F.try_divide(F.count_if(spike & F.col("flag")), F.count_if(spike)).alias("recall"), F.try_divide(F.count_if(~spike & F.col("flag")), F.count_if(~spike)).alias("fpr"), F.try_divide(F.count_if(event & ~F.col("flag")), F.count_if(event)).alias("kept"))
        out = z if out is None else out.unionByName(z)
    return out.withColumn("objective", (F.col("recall") + F.col("kept") + 1 - F.col("fpr")) / 3)


def best_hampel(table: DataFrame) -> DataFrame:
    """The calibration row by objective, recall, kept events, false positives, smaller k: one ordered row."""
    return table.where("split = 'calibration' and window = 11").orderBy(F.desc("objective"), F.desc("recall"), F.desc("kept"), "fpr", "k").limit(1)


def nearest_boundary(df: DataFrame, n: int = 20) -> DataFrame:
    """The n windows nearest to any class boundary (distance, then device and tick)."""
    cfg = FuzzyConfig()
    limits = [(c, getattr(cfg, c)[0]) for c in ("pm2_5", "pm10", "co2")] + [("humidity", cfg.humidity[0]), ("temperature", cfg.temperature[0])]
    near = F.least(*[F.abs(F.col(c) - b) for c, bs in limits for b in bs])
    return df.withColumn("distance", near).where("distance is not null").orderBy("distance", "device", "tick").limit(n)


def perturbed(df: DataFrame, trials: int = 30, seed: int = 42) -> DataFrame:
    """Each row `trials` times, every input moved by up to its channel's uncertainty (hash of seed, row, trial, channel), kept in
    range, PM10 at least PM2.5."""
    x = df.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    for c, (lo, hi, u) in CHANNELS.items():
        key = F.concat_ws(":", F.lit(str(seed)), F.col("device").cast("string"), F.unix_micros(F.col("tick").cast("timestamp")).cast("string"), F.col("trial").cast("string"), F.lit(c))
        draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint").cast("double") / 2147483648.0 - 1
        x = x.withColumn(c, F.when(F.col(c).isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), F.col(c) + u * draw))))
    return x.withColumn("pm10", F.when(F.col("pm10").isNotNull(), F.greatest("pm10", "pm2_5")))


def hash_sample(df: DataFrame, keys: list[str], strata: list[str], n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each stratum, those with the smallest hash of the key: the same for every layout of the data."""
    text = [F.unix_seconds(F.col(k).cast("timestamp")).cast("string") if t.startswith("timestamp") else F.col(k).cast("string") for k, t in ((k, df.schema[k].dataType.simpleString()) for k in keys)]
    w = Window.partitionBy(*strata).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *text)), *keys)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
