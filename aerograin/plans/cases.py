"""Queries of the window studies: profiles by room and season, drivers of critical hours, reasons, weak labels, perturbed
windows under four methods, the choice of a lookback, recall of events, boundary buckets, and streams by the hour."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHANNELS, FuzzyConfig
from ..functions import fuzzy, scores, stats
from ..operators import evaluate, sequence
from ..session import Scratch
from ..sources.adapters import S30, readings_30s, readings_hourly, table
from ..streaming import windows as streams
from . import evaluation, hourly, sensor, sqltext

R = hourly.r6
#: Season of a month. Fixed values.
COLD = (10, 11, 12, 1, 2, 3)
TRIALS = 30
METHODS = sensor.METHODS


def with_profile(df: DataFrame, time: str, exploratory: bool = True) -> DataFrame:
    """profile of each row's room and season, by a small table; where there is none, null (or an error, if not exploratory)."""
    known = F.create_map(*[x for p in evaluate.PROFILES for x in (F.lit(p), F.lit(p))])
    wanted = F.concat_ws("_", "room", F.when(F.month(time).isin(*COLD), "cold").otherwise("warm"))
    found = F.try_element_at(known, wanted)
    return df.withColumn("profile", found if exploratory else F.coalesce(found, F.raise_error(F.concat(F.lit("no profile for "), wanted)).cast("string")))


def infer_by_profile(df: DataFrame) -> DataFrame:
    """The fuzzy index with each row's own temperature profile; a row without one has no component M. `df` is read once."""
    kept = Scratch(df.sparkSession, "profiles").keep(df, "rows")
    out = fuzzy.infer(kept.where("profile is null").withColumn("temperature", F.lit(None).cast("double")))
    for p, e in evaluate.PROFILES.items():
        out = out.unionByName(fuzzy.infer(kept.where(F.col("profile") == p), FuzzyConfig(temperature=(e, 0.5))))
    return out


def profile_index(spark, sf_dir):
    """Windows scored by their room's profile of the season; the general rooms have none for the cold months, so M drops out there
    and completeness is derived anew."""
    x = sensor.windows(spark, sf_dir).withColumn("room", F.when(F.col("device") == 2, "general").otherwise("kitchen"))
    y = infer_by_profile(with_profile(x, "tick"))
    return y.select("device", "tick", "room", F.coalesce("profile", F.lit("")).alias("profile"), "status", F.concat_ws(";", "missing").alias("missing"), F.round("index_value", 5).alias("index_value"))


def pollution_index(spark, sf_dir):
    """The index of A and V alone beside the whole one, by the kind of component that dominates."""
    w = Scratch(spark, "pollution").keep(sensor.windows(spark, sf_dir), "windows")
    both = fuzzy.infer(w).select("device", "tick", "index_value", "co_dominant")
    part = fuzzy.infer(w.withColumns({"temperature": F.lit(None).cast("double"), "humidity": F.lit(None).cast("double")})).select("device", "tick", F.col("index_value").alias("pollution"))
    x = both.join(part, ["device", "tick"])
    air, m = F.exists("co_dominant", lambda c: c != "M"), F.array_contains("co_dominant", "M")
    kind = F.when(air & m, "tie").when(air, "pollution").when(m, "microclimate").otherwise("none")
    g = x.groupBy("device", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count("pollution").alias("n_pollution"), F.avg("pollution").alias("mean_pollution"), F.avg(F.col("index_value") - F.col("pollution")).alias("mean_gap"))
    return g.select("device", "kind", "n", "n_pollution", F.round("mean_pollution", 5).alias("mean_pollution"), F.round("mean_gap", 5).alias("mean_gap"))


def critical_drivers(spark, sf_dir):
    """Critical windows by what dominates them: in all, by day and by hour of the day (grouping sets, one pass)."""
    x = sensor.inferred(spark, sf_dir).where(F.round("index_value", 9) >= 75)
    x = x.select(F.to_date("tick").alias("day"), F.hour("tick").alias("hour"), F.coalesce("dominant", F.lit("")).alias("dominant"), (F.size("co_dominant") > 1).alias("tie"))
    g = x.groupingSets([["dominant"], ["day"], ["hour"]], "dominant", "day", "hour").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("dominant") == c).alias(f"n_{c}") for c in "AVM"], F.count_if("tie").alias("n_ties"))
    return g.select(F.coalesce("dominant", F.col("day").cast("string"), F.concat(F.lit("hour "), F.col("hour").cast("string"))).alias("group"), "n", "n_ties")


def reason_combinations(spark, sf_dir):
    """Reasons that stand together on a slot, and the share of the channel's slots."""
    x = sensor.softly(spark, sf_dir)
    n = x.groupBy("channel").agg(F.count(F.lit(1)).alias("all"))
    y = x.where(F.size("reasons") > 0).groupBy("channel", F.array_join(F.array_sort(F.array_distinct("reasons")), "+").alias("combination")).agg(F.count(F.lit(1)).alias("n"))
    return y.join(F.broadcast(n), "channel").select("channel", "combination", "n", F.round(F.col("n") / F.col("all"), 6).alias("rate"))  # one row a channel


def reasons_by_day(spark, sf_dir):
    x = sensor.softly(spark, sf_dir).select("channel", F.to_date("slot").alias("day"), F.explode("reasons").alias("reason"))
    return x.groupBy("channel", "day", "reason").agg(F.count(F.lit(1)).alias("n"))


def dominant_frequency(spark, sf_dir):
    """How often each component dominates, per device, among the windows with an index."""
    x = sensor.inferred(spark, sf_dir).where("index_value is not null")
    g = x.groupBy("device", F.coalesce("dominant", F.lit("")).alias("dominant")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("device")), 6))


def hardcheck_flags(spark, sf_dir):
    """Range violations by channel (a missing value is none) in a local-time window, and rows with any."""
    x = readings_30s(spark, sf_dir).withColumn("local", F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Kyiv"))
    fail = {c: F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False)) for c, (lo, hi, _) in CHANNELS.items()}
    x = x.withColumns({f"hardcheck_fail_{c}": f for c, f in fail.items()}).where((F.col("local") >= F.lit("2024-01-01 03:00:00").cast("timestamp")) & (F.col("local") < F.lit("2024-01-09 00:00:00").cast("timestamp")))
    anyone = F.greatest(*[F.col(f"hardcheck_fail_{c}") for c in CHANNELS])
    return x.groupBy("device").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f"hardcheck_fail_{c}").alias(f"n_{c}") for c in CHANNELS], F.count_if(anyone).alias("n_any"))


def requested_interval(spark, sf_dir):
    """Readings from a start up to, but not at, an end."""
    x = readings_30s(spark, sf_dir).where("ts >= timestamp_ntz'2024-01-01 06:00:00' and ts < timestamp_ntz'2024-01-01 12:00:00'")
    return x.groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def mad_of_differences(spark, sf_dir):
    """Median absolute deviation of the steps of valid CO2 readings in each device's first 70 % of time."""
    x = readings_30s(spark, sf_dir)
    us, w = sequence.micros(F.col("ts")), Window.partitionBy("device")
    x = x.withColumn("train", us <= F.min(us).over(w) + 0.7 * (F.max(us).over(w) - F.min(us).over(w))).where("train")
    lo, hi, _ = CHANNELS["co2"]
    x = x.withColumn("x", F.when(F.col("co2").between(lo, hi), F.col("co2")))
    d = x.withColumn("d", F.col("x") - F.lag("x").over(w.orderBy("ts"))).where("d is not null")
    med = d.groupBy("device").agg(F.percentile("d", 0.5).alias("m"))
    return d.join(F.broadcast(med), "device").groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile(F.abs(F.col("d") - F.col("m")), 0.5), 6).alias("mad"))  # one row a device


LABELLED = ("co2", "temperature")
HALF, LEAST_ROWS, HIGH, LASTING = 120, 121, 3.0, 4


def weak_labels(df: DataFrame, channel: str) -> DataFrame:
    """device, ts, score, event of one channel: centred robust deviation over 241 rows of a day (121 at least), and whether it
    stays over the limit for four rows or more within the day."""
    lo, hi, _ = CHANNELS[channel]
    x = df.select("device", "ts", F.to_date("ts").alias("day"), F.when(F.col(channel).between(lo, hi), F.col(channel)).alias("x"))
    w = Window.partitionBy("device", "day").orderBy("ts")
    frame = w.rowsBetween(-HALF, HALF)
    x = x.withColumn("m", F.when(F.count("x").over(frame) >= LEAST_ROWS, F.percentile("x", 0.5).over(frame))).withColumn("d", F.abs(F.col("x") - F.col("m")))
    x = x.withColumn("mad", F.when(F.count("d").over(frame) >= LEAST_ROWS, F.percentile("d", 0.5).over(frame)) * 1.4826)
    x = x.withColumn("score", F.when(F.col("mad") > 0, F.col("d") / F.col("mad"))).withColumn("high", F.coalesce(F.col("score") > HIGH, F.lit(False)))
    x = x.withColumn("g", F.sum(F.when(F.col("high") == F.lag("high").over(w), 0).otherwise(1)).over(w))
    return x.select("device", "ts", "score", (F.col("high") & (F.count(F.lit(1)).over(Window.partitionBy("device", "day", "g")) >= LASTING)).alias("event"))


def event_intervals(spark, sf_dir):
    """Stretches in which any channel has an event: start, end, rows, the channels that set it off, the highest score."""
    base = readings_30s(spark, sf_dir).select("device", "ts", *LABELLED)
    x = None
    for c in LABELLED:
        y = weak_labels(base, c).select("device", "ts", F.col("score").alias(f"score_{c}"), F.col("event").alias(f"event_{c}"))
        x = y if x is None else x.join(y, ["device", "ts"])
    w = Window.partitionBy("device").orderBy("ts")
    x = x.withColumn("any", F.greatest(*[F.col(f"event_{c}") for c in LABELLED]))
    x = x.withColumn("g", F.sum(F.when(F.col("any") == F.lag("any").over(w), 0).otherwise(1)).over(w)).where("any")
    on = [F.when(F.bool_or(f"event_{c}"), F.lit(c)) for c in sorted(LABELLED)]
    g = x.groupBy("device", "g").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"), F.concat_ws(",", *on).alias("triggers"), F.max(F.greatest(*[F.col(f"score_{c}") for c in LABELLED])).alias("peak"))
    return g.select("device", "start", "end", "n", "triggers", F.round("peak", 5).alias("peak"))


AXIS = (0.0, 10.0, 25.0, 40.0, 50.0, 60.0, 74.5, 75.0, 75.5, 90.0, 100.0)
BUCKETS = {
    "all": "true", "any_at_25": "a = 25 or v = 25 or m = 25", "any_at_50": "a = 50 or v = 50 or m = 50", "any_at_75": "a = 75 or v = 75 or m = 75",
    "none_at_boundary": "a not in (25, 50, 75) and v not in (25, 50, 75) and m not in (25, 50, 75)", "max_at_75": "greatest(a, v, m) = 75",
    "max_below_75": "greatest(a, v, m) >= 74 and greatest(a, v, m) < 75", "max_above_75": "greatest(a, v, m) > 75 and greatest(a, v, m) <= 76",
}


def boundary_buckets(spark, sf_dir):
    """Index against the largest component on a grid, in eight buckets about the class boundaries: conditions, not scans."""
    axis = F.array(*[F.lit(x) for x in AXIS])
    x = spark.range(1).select(F.explode(axis).alias("a"), F.lit(0).alias("z")).select("a", F.explode(axis).alias("v")).select("a", "v", F.explode(axis).alias("m"))
    x = evaluate.score_methods(x).withColumn("d", F.abs(F.col("two_level") - F.col("fuzzy_max"))).withColumn("same", F.col("sev_two_level") == F.col("sev_fuzzy_max"))
    y = x.select("d", "same", F.explode(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(b)) for b, c in BUCKETS.items()]))).alias("bucket"))
    g = y.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("n_same"), F.avg("d").alias("mean_d"), F.percentile("d", 0.5).alias("median_d"), F.percentile("d", 0.95).alias("p95_d"), F.max("d").alias("max_d"))
    return g.select("bucket", "n", "n_same", *[F.round(c, 5).alias(c) for c in ("mean_d", "median_d", "p95_d", "max_d")])


BANDS = (("hidden", 0.01), ("under", 0.01), ("class_mae", 0.02), ("mae", 0.5))


def lookback_metrics(spark, sf_dir) -> DataFrame:
    """Every good CO2 reading estimated by the last one of 5 to 30 minutes: critical ones hidden, underestimates, class and value errors."""
    x = readings_30s(spark, sf_dir).where("lower(status) = 'ok'")
    us = sequence.micros(F.col("ts"))
    x = x.withColumns({f"locf_{m}": F.last("co2").over(Window.partitionBy("device").orderBy(us).rangeBetween(-m * 60_000_000, -1)) for m in sensor.LOOKBACKS})
    long = x.select("co2", F.expr(f"stack({len(sensor.LOOKBACKS)}, {', '.join(f'{m}, locf_{m}' for m in sensor.LOOKBACKS)}) as (lookback, e)")).where("e is not null")
    limits = FuzzyConfig().co2[0]
    long = long.withColumns({"t": scores.hard_class(F.col("co2"), limits), "p": scores.hard_class(F.col("e"), limits)})
    return long.groupBy("lookback").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.count_if((F.col("t") == 3) & (F.col("p") < 3)), F.count_if(F.col("t") == 3)).alias("hidden"), F.avg((F.col("e") < F.col("co2")).cast("int")).alias("under"), F.avg(F.abs(F.col("p") - F.col("t"))).alias("class_mae"), F.avg(F.abs(F.col("e") - F.col("co2"))).alias("mae"))


def lookback_choice(spark, sf_dir):
    """The lookback to use: metric after metric, those within its band of the best stay; of the last ones the shortest."""
    x, w = lookback_metrics(spark, sf_dir).withColumn("alive", F.lit(True)), Window.partitionBy()
    for c, eps in BANDS:  # a table of four rows
        best = F.min(F.when(F.col("alive"), F.col(c))).over(w)
        x = x.withColumn("alive", F.col("alive") & (best.isNull() | (F.col(c) <= best + eps)))
    x = x.withColumn("chosen", F.col("alive") & (F.col("lookback") == F.min(F.when(F.col("alive"), F.col("lookback"))).over(w)))
    return x.select("lookback", "n", *R(*[c for c, _ in BANDS]), "chosen")


def chronological_sample(spark, sf_dir):
    """Complete windows dealt to calibration (first 70 %) and validation in order of time, and 300 of them kept in the same shares."""
    x = sensor.inferred(spark, sf_dir).where("status = 'OK'").select("device", "tick")
    w = Window.partitionBy("device")
    x = x.withColumns({"k": F.row_number().over(w.orderBy("tick")), "n": F.count(F.lit(1)).over(w)})
    x = x.withColumn("part", F.when(F.col("k") <= F.round(0.7 * F.col("n")), "calibration").otherwise("validation"))
    draw = F.md5(F.concat_ws(":", F.lit("42"), F.col("device").cast("string"), sequence.micros(F.col("tick")).cast("string")))
    y = x.withColumn("r", F.row_number().over(Window.partitionBy("device", "part").orderBy(draw))).where(F.col("r") <= F.when(F.col("part") == "calibration", 210).otherwise(90))
    return y.groupBy("device", "part").agg(F.count(F.lit(1)).alias("n"), F.min("tick").alias("first"), F.max("tick").alias("last"))


def remaining_hours(spark, sf_dir):
    """What the stratified sample leaves: all complete hours less the selected ones."""
    x = hourly.indexed(spark, sf_dir).where(scores.complete()).select("home", "time", "season", "class_I")
    picked = evaluate.hash_sample(x, ["home", "time"], ["home", "class_I"], 5).select("home", "time")
    rest = x.join(picked, ["home", "time"], "left_anti")
    merged = x.join(picked.withColumn("picked", F.lit(True)), ["home", "time"], "left")
    a = rest.groupBy("home", "class_I").agg(F.count(F.lit(1)).alias("n_rest"))
    return merged.groupBy("home", "class_I").agg(F.count("picked").alias("n_picked")).join(a, ["home", "class_I"], "left").na.fill(0, ["n_rest"])


def event_recall(spark, sf_dir):
    """Purchases with an error of the same user within a widened interval about them: 0, 30 and 60 minutes on either side."""
    e = table(spark, sf_dir, "events")
    hits = e.where("event_type = 'error'").select("user_id", "ts", "event_type")
    out = None
    for w in (0, 30, 60):
        spans = e.where("event_type = 'purchase'").select("user_id", F.expr(f"ts - make_dt_interval(0, 0, {w})").alias("start"), F.expr(f"ts + make_dt_interval(0, 1, {w})").alias("end"), F.col("event_id").alias("span_id"))
        got = sequence.within_intervals(hits, spans, "user_id", "ts", "start", "end", 7_200_000_000 + w * 120_000_000, "inner").select(F.col("ev_span_id").alias("span_id")).distinct().withColumn("hit", F.lit(1))
        x = spans.join(got, "span_id", "left").agg(F.lit(w).alias("w"), F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_hit"))
        out = x if out is None else out.unionByName(x)
    return out.withColumn("recall", F.round(F.col("n_hit") / F.col("n"), 6))


def _trials(spark, sf_dir) -> DataFrame:
    """The twenty windows nearest to a boundary (trial 0) and their perturbed trials, scored by all methods; written once."""
    base = evaluate.nearest_boundary(sensor.windows(spark, sf_dir)).drop("distance")
    scratch = Scratch(spark, "trials")
    base = scratch.keep(base, "base")
    every = base.withColumn("trial", F.lit(0)).unionByName(evaluate.perturbed(base, TRIALS))
    x = sensor.with_baselines(fuzzy.infer(every))
    rows = ", ".join(f"'{m}', {c}" for m, c in METHODS.items())
    return scratch.keep(x.select("device", "tick", "trial", F.expr(f"stack({len(METHODS)}, {rows}) as (method, sev)")), "scored")


def method_stability(spark, sf_dir):
    """Perturbed windows under each of four methods: class changes with Wilson bounds, to the worse and to the better."""
    x = _trials(spark, sf_dir)
    before = x.where("trial = 0").select("device", "tick", "method", F.col("sev").alias("sev0"))
    y = x.where("trial > 0").join(before, ["device", "tick", "method"])
    g = y.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("sev").eqNullSafe(F.col("sev0"))).alias("k"), F.count_if(F.col("sev") > F.col("sev0")).alias("n_worse"), F.count_if(F.col("sev") < F.col("sev0")).alias("n_better"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return g.select("method", "n", "k", "n_worse", "n_better", F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


def method_stability_paired(spark, sf_dir):
    """The index against each other method on the same trials: who changed where the other did not, exact McNemar, Holm."""
    x = _trials(spark, sf_dir)
    before = x.where("trial = 0").select("device", "tick", "method", F.col("sev").alias("sev0"))
    y = x.where("trial > 0").join(before, ["device", "tick", "method"]).withColumn("changed", ~F.col("sev").eqNullSafe(F.col("sev0")))
    wide = y.groupBy("device", "tick", "trial").pivot("method", list(METHODS)).agg(F.first("changed"))
    others = [m for m in METHODS if m != "TWO_LEVEL"]
    long = wide.select(F.expr(f"stack({len(others)}, {', '.join(f"'{m}', TWO_LEVEL, {m}" for m in others)}) as (other, a, b)"))
    g = long.groupBy("other").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("a and not b")).alias("only_index"), F.count_if(F.expr("b and not a")).alias("only_other"))
    g = stats.holm(g.withColumn("p", stats.mcnemar_p(F.col("only_index"), F.col("only_other"))).withColumn("one", F.lit(1)), ["one"], "p")
    return g.select("other", "n", "only_index", "only_other", *R("p", "p_holm"))


def stream_hours(spark, sf_dir):
    """Tumbling hours of a stream, two hours late at most."""
    e = evaluation_stream(spark, sf_dir)
    x = e.withColumn("device", F.col("user_id") % 4)
    return streams.upserted(streams.sliding(x, "device", "ts", "value", "1 hour", "1 hour", "2 hours"), ["device", "window_end"], "hours").select("device", "window_end", "n", F.round("mean", 6).alias("mean"))


def evaluation_stream(spark, sf_dir) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


def stream_stale_outdoor(spark, sf_dir):
    """A stream of readings joined with the outdoor table of the hour before: whether what is known outdoors is stale (two hours)."""
    out = readings_hourly(spark, sf_dir).where("pm25 is not null").select(F.col("home").alias("device"), F.col("time").alias("out_time"))
    hour = lambda c: F.unix_seconds(F.col(c).cast("timestamp")).cast("bigint")
    e = evaluation_stream(spark, sf_dir).select((F.col("user_id") % 4).alias("device"), "ts", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("back"))
    e = e.withColumn("slot", F.floor(hour("ts") / 3600) - F.col("back"))
    got = e.join(out.withColumn("slot", F.floor(hour("out_time") / 3600)), ["device", "slot"], "left")
    second = lambda c: F.rint(F.unix_micros(F.col(c).cast("timestamp")) / 1e6).cast("bigint")  # noqa: E731  nearest, ties to even, as in the SQL
    got = got.where("out_time <= ts").select("device", "ts", (second("ts") - second("out_time")).alias("age_s"))
    rows = streams.appended(got, "stale")
    best = rows.groupBy("device", "ts").agg(F.min("age_s").alias("age_s"))
    n = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("device"), "ts").distinct().groupBy("device").agg(F.count(F.lit(1)).alias("n"))
    fresh = best.where("age_s <= 7200").groupBy("device").agg(F.count(F.lit(1)).alias("n_fresh"))
    return n.join(fresh, "device", "left").select("device", "n", (F.col("n") - F.coalesce("n_fresh", F.lit(0))).alias("n_stale"))


QUERIES = {f.__name__: f for f in (profile_index, pollution_index, critical_drivers, reason_combinations, reasons_by_day, dominant_frequency, hardcheck_flags, requested_interval, mad_of_differences, event_intervals, boundary_buckets, lookback_choice, chronological_sample, remaining_hours, event_recall, method_stability, method_stability_paired, stream_hours, stream_stale_outdoor)}

# --- SQL -------------------------------------------------------------------------------------------------------------
_KEY = "device, tick"
_LISTED = ", ".join(f"[{n}0, {n}1, {n}2, {n}3] AS l{n}" for n in "AVM")


def dominance_ctes(source: str = "hf", key: str = _KEY) -> str:
    """CTE `dm`: {source} with dominant and co_dominant, from all rules listed."""
    pick = {"A": "i", "V": "j", "M": "k"}
    deg = ", ".join(f"l{n}[{p} + 1] AS g{n}" for n, p in pick.items())
    own = ", ".join(f"max({p}) FILTER (g{n} IS NOT NULL AND abs(g{n} - s) <= 1e-9) AS w{n}" for n, p in pick.items())
    only = " AND ".join(f"(l{n}[1] IS NOT NULL OR {p} = 0)" for n, p in pick.items())
    return f"""d0 AS (SELECT {key}, {_LISTED} FROM {source}), d1 AS (SELECT *, {deg} FROM d0 CROSS JOIN (SELECT unnest(range(4)) AS i) CROSS JOIN (SELECT unnest(range(4)) AS j) CROSS JOIN (SELECT unnest(range(4)) AS k) WHERE {only}),
d2 AS (SELECT *, least(gA, gV, gM) AS s, greatest(i, j, k) AS c FROM d1), d3 AS (SELECT * FROM d2 QUALIFY s > 0 AND s >= max(s) OVER (PARTITION BY {key}) - 1e-9), d4 AS (SELECT * FROM d3 QUALIFY c = max(c) OVER (PARTITION BY {key})),
d5 AS (SELECT {key}, {own} FROM d4 GROUP BY {key}), d6 AS (SELECT *, greatest(wA, wV, wM) AS w FROM d5),
d7 AS (SELECT h.*, CASE WHEN wA = w THEN "score_A" END AS pA, CASE WHEN wM = w THEN "score_M" END AS pM, CASE WHEN wV = w THEN "score_V" END AS pV FROM {source} h LEFT JOIN d6 USING ({key})),
dm AS (SELECT *, list_filter([CASE WHEN greatest(pA, pM, pV) - pA <= 1 THEN 'A' END, CASE WHEN greatest(pA, pM, pV) - pM <= 1 THEN 'M' END, CASE WHEN greatest(pA, pM, pV) - pV <= 1 THEN 'V' END], lambda z: z IS NOT NULL) AS co FROM d7)"""


_WIN = f"win AS (SELECT device, tick, {', '.join(f"any_value(mean) FILTER (channel = '{c}') AS {c}" for c in sensor.WIDE)} FROM agg GROUP BY device, tick)"
_DM = f"WITH {sensor._WIDE_SQL}, {dominance_ctes()}"
_PART = sensor.fuzzy_ctes("pwin", _KEY)
for _n in ("uni", "hm", "hc", "ho", "ca", "cv", "cm", "ci", "hf"):  # the same steps under other names
    _PART = re.sub(rf"\b{_n}\b", f"p_{_n}", _PART)
_DRAW = lambda c: f"(('0x' || substr(md5('42:' || device || ':' || epoch_us(tick) || ':' || trial || ':{c}'), 1, 8))::BIGINT::DOUBLE / 2147483648.0 - 1)"
_MOVED = ", ".join(f"CASE WHEN trial = 0 THEN {c} WHEN {c} IS NOT NULL THEN least({hi}::DOUBLE, greatest({lo}::DOUBLE, {c} + {u} * {_DRAW(c)})) END AS {c}" for c, (lo, hi, u) in CHANNELS.items())
_TRIED = f"""{sensor._AGG}, {_WIN}, nd AS (SELECT *, {evaluation._NEAR} AS distance FROM win), nb AS (SELECT * FROM nd WHERE distance IS NOT NULL ORDER BY distance, device, tick LIMIT 20),
tr0 AS (SELECT *, unnest(range(0, {TRIALS + 1}))::INT AS trial FROM nb), tr1 AS (SELECT device, tick, trial, {_MOVED} FROM tr0), tw AS (SELECT * REPLACE (CASE WHEN trial > 0 AND pm10 IS NOT NULL THEN greatest(pm10, pm2_5) ELSE pm10 END AS pm10) FROM tr1),
{sensor.fuzzy_ctes('tw', 'device, tick, trial')}, {sensor.baseline_cte()}, sc AS ({' UNION ALL '.join(f"SELECT device, tick, trial, '{m}' AS method, {c} AS sev FROM bl" for m, c in METHODS.items())}),
ch AS (SELECT a.*, b.sev AS sev0, a.sev IS DISTINCT FROM b.sev AS changed FROM sc a JOIN sc b USING (device, tick, method) WHERE a.trial > 0 AND b.trial = 0)"""
_BINOMIAL = lambda a, b: f"CASE WHEN {a} + {b} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({a}, {b}) + 1), lambda i: exp(lgamma({a} + {b} + 1) - lgamma(i + 1) - lgamma({a} + {b} - i + 1) - ({a} + {b}) * ln(2))))) END"
_LABEL = lambda c: f"""x_{c} AS (SELECT device, ts, ts::DATE AS day, CASE WHEN {c} BETWEEN {CHANNELS[c][0]} AND {CHANNELS[c][1]} THEN {c} END AS x FROM readings30),
m_{c} AS (SELECT *, CASE WHEN count(x) OVER w >= {LEAST_ROWS} THEN median(x) OVER w END AS m FROM x_{c} WINDOW w AS (PARTITION BY device, day ORDER BY ts ROWS BETWEEN {HALF} PRECEDING AND {HALF} FOLLOWING)),
a_{c} AS (SELECT *, abs(x - m) AS d FROM m_{c}), s_{c} AS (SELECT *, CASE WHEN count(d) OVER w >= {LEAST_ROWS} THEN median(d) OVER w END * 1.4826 AS mad FROM a_{c} WINDOW w AS (PARTITION BY device, day ORDER BY ts ROWS BETWEEN {HALF} PRECEDING AND {HALF} FOLLOWING)),
h_{c} AS (SELECT *, CASE WHEN mad > 0 THEN d / mad END AS score, coalesce(CASE WHEN mad > 0 THEN d / mad END > {HIGH}, false) AS high FROM s_{c}), k_{c} AS (SELECT *, high IS DISTINCT FROM lag(high) OVER (PARTITION BY device, day ORDER BY ts) AS new FROM h_{c}),
g_{c} AS (SELECT *, sum(new::INT) OVER (PARTITION BY device, day ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM k_{c}), e_{c} AS (SELECT device, ts, score, high AND count(*) OVER (PARTITION BY device, day, g) >= {LASTING} AS event FROM g_{c})"""  # noqa: E731
_LOOK = " UNION ALL ".join(f"SELECT {m} AS lookback, co2, {sensor._BEFORE('last_value(co2)', m)} AS e FROM readings30 WHERE lower(status) = 'ok'" for m in sensor.LOOKBACKS)
_ALIVE = ", ".join(f"b{i + 1} AS (SELECT *, a{i} AND (min({c}) FILTER (a{i}) OVER () IS NULL OR {c} <= min({c}) FILTER (a{i}) OVER () + {eps}) AS a{i + 1} FROM b{i})" for i, (c, eps) in enumerate(BANDS))

SQL = {
    "profile_index": f"""WITH {sensor._AGG}, {_WIN.replace('win AS', 'win0 AS')}, win1 AS (SELECT *, CASE WHEN device = 2 THEN 'general' ELSE 'kitchen' END AS room, month(tick) IN (10, 11, 12, 1, 2, 3) AS cold FROM win0),
win AS (SELECT * REPLACE (CASE WHEN room = 'kitchen' AND cold THEN temperature END AS temperature) FROM win1), {sensor.fuzzy_ctes('win', _KEY)}
SELECT device, tick, room, CASE WHEN room = 'kitchen' AND cold THEN 'kitchen_cold' ELSE '' END AS profile, status, concat_ws(';', CASE WHEN "score_A" IS NULL THEN 'A' END, CASE WHEN "score_M" IS NULL THEN 'M' END, CASE WHEN "score_V" IS NULL THEN 'V' END) AS missing, round(index_value, 5) AS index_value FROM hf""",
    "pollution_index": f"""{_DM}, pwin AS (SELECT device, tick, pm2_5, pm10, co2, NULL::DOUBLE AS temperature, NULL::DOUBLE AS humidity FROM win), {_PART},
x AS (SELECT a.device, a.co, a.index_value AS whole, b.index_value AS part FROM dm a JOIN p_hf b USING (device, tick)), k AS (SELECT *, CASE WHEN len(list_filter(co, lambda c: c <> 'M')) > 0 AND list_contains(co, 'M') THEN 'tie' WHEN len(list_filter(co, lambda c: c <> 'M')) > 0 THEN 'pollution' WHEN list_contains(co, 'M') THEN 'microclimate' ELSE 'none' END AS kind FROM x)
SELECT device, kind, count(*) AS n, count(part) AS n_pollution, round(avg(part), 5) AS mean_pollution, round(avg(whole - part), 5) AS mean_gap FROM k GROUP BY device, kind""",
    "critical_drivers": f"""{_DM}, x AS (SELECT tick::DATE::VARCHAR AS day, 'hour ' || hour(tick) AS hour, coalesce(co[1], '') AS dominant, len(co) > 1 AS tie FROM dm WHERE round(index_value, 9) >= 75),
g AS (SELECT dominant AS "group", tie FROM x UNION ALL SELECT day, tie FROM x UNION ALL SELECT hour, tie FROM x) SELECT "group", count(*) AS n, count_if(tie)::BIGINT AS n_ties FROM g GROUP BY "group\"""",
    "dominant_frequency": f"{_DM}, g AS (SELECT device, coalesce(co[1], '') AS dominant, count(*) AS n FROM dm WHERE index_value IS NOT NULL GROUP BY ALL) SELECT device, dominant, n, round(n / sum(n) OVER (PARTITION BY device), 6) AS share FROM g",
    "reason_combinations": f"""WITH {sensor._SOFT}, a AS (SELECT channel, count(*) AS k FROM soft GROUP BY channel), c AS (SELECT channel, array_to_string(list_sort(list_distinct(reasons)), '+') AS combination, count(*) AS n FROM soft WHERE len(reasons) > 0 GROUP BY ALL)
SELECT channel, combination, n, round(n / k, 6) AS rate FROM c JOIN a USING (channel)""",
    "reasons_by_day": f"WITH {sensor._SOFT}, e AS (SELECT channel, slot::DATE AS day, unnest(reasons) AS reason FROM soft) SELECT channel, day, reason, count(*) AS n FROM e GROUP BY ALL",
    "hardcheck_flags": f"""WITH {S30}, f AS (SELECT device, {', '.join(f'coalesce({c} < {lo} OR {c} > {hi}, false) AS f_{c}' for c, (lo, hi, _) in CHANNELS.items())} FROM readings30 WHERE ts + INTERVAL 2 HOUR >= TIMESTAMP '2024-01-01 03:00:00' AND ts + INTERVAL 2 HOUR < TIMESTAMP '2024-01-09')
SELECT device, count(*) AS n, {', '.join(f'count_if(f_{c})::BIGINT AS n_{c}' for c in CHANNELS)}, count_if({' OR '.join(f'f_{c}' for c in CHANNELS)})::BIGINT AS n_any FROM f GROUP BY device""",
    "requested_interval": f"WITH {S30} SELECT device, count(*) AS n, min(ts) AS first, max(ts) AS last FROM readings30 WHERE ts >= TIMESTAMP '2024-01-01 06:00:00' AND ts < TIMESTAMP '2024-01-01 12:00:00' GROUP BY device",
    "mad_of_differences": f"""WITH {S30}, s AS (SELECT device, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM readings30 GROUP BY device), x AS (SELECT device, ts, CASE WHEN co2 BETWEEN {CHANNELS['co2'][0]} AND {CHANNELS['co2'][1]} THEN co2 END AS x FROM readings30 JOIN s USING (device) WHERE epoch_us(ts) <= a + 0.7::DOUBLE * (b - a)),
d AS (SELECT device, x - lag(x) OVER (PARTITION BY device ORDER BY ts) AS d FROM x), m AS (SELECT device, median(d) AS m FROM d GROUP BY device) SELECT device, count(*) AS n, round(median(abs(d - m)), 6) AS mad FROM d JOIN m USING (device) WHERE d IS NOT NULL GROUP BY device""",
    "event_intervals": f"""WITH {S30}, {', '.join(_LABEL(c) for c in LABELLED)}, j AS (SELECT a.device, a.ts, a.event AS ea, b.event AS eb, greatest(a.score, b.score) AS top, a.event OR b.event AS hit FROM e_{LABELLED[0]} a JOIN e_{LABELLED[1]} b USING (device, ts)),
n AS (SELECT *, hit IS DISTINCT FROM lag(hit) OVER (PARTITION BY device ORDER BY ts) AS new FROM j), g AS (SELECT *, sum(new::INT) OVER (PARTITION BY device ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM n)
SELECT device, min(ts) AS start, max(ts) AS "end", count(*) AS n, concat_ws(',', CASE WHEN bool_or(ea) THEN '{LABELLED[0]}' END, CASE WHEN bool_or(eb) THEN '{LABELLED[1]}' END) AS triggers, round(max(top), 5) AS peak FROM g WHERE hit GROUP BY device, g""",
    "boundary_buckets": f"""WITH ax AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in AXIS)}]) AS x), cb AS (SELECT p.x AS a, q.x AS v, r.x AS m FROM ax p CROSS JOIN ax q CROSS JOIN ax r), {evaluation._methods('cb')},
b AS ({' UNION ALL '.join(f"SELECT '{n}' AS bucket, abs(two_level - fuzzy_max) AS d, sev_two_level = sev_fuzzy_max AS same FROM sm WHERE {c}" for n, c in BUCKETS.items())})
SELECT bucket, count(*) AS n, count_if(same)::BIGINT AS n_same, round(avg(d), 5) AS mean_d, round(median(d), 5) AS median_d, round(quantile_cont(d, 0.95), 5) AS p95_d, round(max(d), 5) AS max_d FROM b GROUP BY bucket""",
    "lookback_choice": f"""WITH {S30}, l AS ({_LOOK}), c AS (SELECT *, {sensor._hard('co2', FuzzyConfig().co2[0])} AS t, {sensor._hard('e', FuzzyConfig().co2[0])} AS p FROM l WHERE e IS NOT NULL),
b0 AS (SELECT lookback, count(*) AS n, count_if(t = 3 AND p < 3) / nullif(count_if(t = 3), 0) AS hidden, avg((e < co2)::INT) AS under, avg(abs(p - t)) AS class_mae, avg(abs(e - co2)) AS mae, true AS a0 FROM c GROUP BY lookback), {_ALIVE}
SELECT lookback, n, {', '.join(f'round({c}, 6) AS {c}' for c, _ in BANDS)}, a4 AND lookback = min(lookback) FILTER (a4) OVER () AS chosen FROM b4""",
    "chronological_sample": f"""WITH {sensor._WIDE_SQL}, k AS (SELECT device, tick, row_number() OVER (PARTITION BY device ORDER BY tick) AS k, count(*) OVER (PARTITION BY device) AS n FROM hf WHERE status = 'OK'), p AS (SELECT *, CASE WHEN k <= round(0.7 * n) THEN 'calibration' ELSE 'validation' END AS part FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY device, part ORDER BY md5('42:' || device || ':' || epoch_us(tick))) AS r FROM p) SELECT device, part, count(*) AS n, min(tick) AS first, max(tick) AS last FROM r WHERE r <= CASE part WHEN 'calibration' THEN 210 ELSE 90 END GROUP BY device, part""",
    "remaining_hours": f"""WITH {sqltext.GRID}, {sqltext.index()}, r AS (SELECT home, "class_I", row_number() OVER (PARTITION BY home, "class_I" ORDER BY md5('42:' || home || ':' || epoch(time)::BIGINT), time) AS r FROM idx WHERE "I" IS NOT NULL)
SELECT home, "class_I", count_if(r <= 5)::BIGINT AS n_picked, count_if(r > 5)::BIGINT AS n_rest FROM r GROUP BY home, "class_I\"""",
    "event_recall": " UNION ALL ".join(f"SELECT {w} AS w, count(*) AS n, count_if(hit)::BIGINT AS n_hit, round(count_if(hit) / count(*), 6) AS recall FROM (SELECT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.user_id = p.user_id AND e.ts >= p.ts - INTERVAL {w} MINUTE AND e.ts <= p.ts + INTERVAL {60 + w} MINUTE) AS hit FROM events p WHERE p.event_type = 'purchase')" for w in (0, 30, 60)),
    "method_stability": f"""WITH {_TRIED}, g AS (SELECT method, count(*) AS n, count_if(changed)::BIGINT AS k, count_if(sev > sev0)::BIGINT AS n_worse, count_if(sev < sev0)::BIGINT AS n_better FROM ch GROUP BY method),
p AS (SELECT *, 1.96 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n) AS h, (k / n::DOUBLE + 3.8416 / (2.0 * n)) / (1 + 3.8416 / n) AS c FROM g) SELECT method, n, k, n_worse, n_better, round(greatest(0.0, c - h), 6) AS low, round(least(1.0, c + h), 6) AS high FROM p""",
    "method_stability_paired": f"""WITH {_TRIED}, g AS (SELECT b.method AS other, count(*) AS n, count_if(a.changed AND NOT b.changed)::BIGINT AS only_index, count_if(b.changed AND NOT a.changed)::BIGINT AS only_other FROM ch a JOIN ch b USING (device, tick, trial) WHERE a.method = 'TWO_LEVEL' AND b.method <> 'TWO_LEVEL' GROUP BY b.method),
p AS (SELECT *, {_BINOMIAL('only_index', 'only_other')} AS p FROM g), r AS (SELECT *, row_number() OVER (ORDER BY p) AS i, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) * p) AS raw FROM p)
SELECT other, n, only_index, only_other, round(p, 6) AS p, round(max(raw) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM r""",
    "stream_hours": "WITH e AS (SELECT user_id % 4 AS device, value, ((epoch_us(ts) - 1) // 3600000000 + 1) * 3600000000 AS e FROM events) SELECT device, make_timestamp(e) AS window_end, count(value) AS n, round(avg(value), 6) AS mean FROM e GROUP BY device, e",
    "stream_stale_outdoor": f"""WITH {sqltext.HOURLY}, o AS (SELECT home AS device, time FROM readings WHERE pm25 IS NOT NULL), e AS (SELECT DISTINCT user_id % 4 AS device, ts FROM events), j AS (SELECT e.device, e.ts, o.time FROM e ASOF LEFT JOIN o ON e.device = o.device AND e.ts >= o.time)
SELECT device, count(*) AS n, count_if(time IS NULL OR epoch(ts)::BIGINT - epoch(time)::BIGINT > 7200)::BIGINT AS n_stale FROM j GROUP BY device""",
}
_CLASS_NAME = "CASE {0} WHEN 0 THEN 'Favourable' WHEN 1 THEN 'Acceptable' WHEN 2 THEN 'Degraded' WHEN 3 THEN 'Critical' END"
_INDEXED = f"ix AS (SELECT device, tick, trial, index_value, {sensor.sev_sql('index_value')} AS sev FROM hf)"
_TRIED_INDEX = _TRIED[: _TRIED.index(", b0 AS (")] + f", {_INDEXED}"
#: Queries of the sensor and evaluation plans whose SQL lists all rules or all trials.
SQL |= {
    "dominant_component": f"{_DM} SELECT device, tick, status, {_CLASS_NAME.format(sensor.sev_sql('index_value').replace('CASE', '(CASE', 1) + ')')} AS index_class, coalesce(co[1], '') AS dominant, coalesce(array_to_string(co, ';'), '') AS co_dominant FROM dm",
    "trial_flapping": f"""WITH {_TRIED_INDEX}, t AS (SELECT *, sev <> lag(sev) OVER (PARTITION BY device, tick ORDER BY trial) AS turn FROM ix WHERE trial > 0 AND sev IS NOT NULL) SELECT device, tick, count(*) AS n, count_if(turn)::BIGINT AS n_turns FROM t GROUP BY device, tick""",
    "stability": f"""WITH {_TRIED_INDEX}, c AS (SELECT a.device, abs(a.index_value - b.index_value) AS d, a.sev - b.sev AS w FROM ix a JOIN ix b USING (device, tick) WHERE a.trial > 0 AND b.trial = 0 AND a.index_value IS NOT NULL AND b.index_value IS NOT NULL),
g AS (SELECT device, count(*) AS n, count_if(w <> 0)::BIGINT AS k, count_if(w > 0)::BIGINT AS n_worse, count_if(w < 0)::BIGINT AS n_better, avg(d) AS mean_shift, quantile_cont(d, 0.95) AS p95_shift, max(d) AS max_shift FROM c GROUP BY device),
p AS (SELECT *, 1.96 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n) AS h, (k / n::DOUBLE + 3.8416 / (2.0 * n)) / (1 + 3.8416 / n) AS c FROM g)
SELECT device, n, k, n_worse, n_better, round(mean_shift, 6) AS mean_shift, round(p95_shift, 6) AS p95_shift, round(max_shift, 6) AS max_shift, round(greatest(0.0, c - h), 6) AS low, round(least(1.0, c + h), 6) AS high FROM p""",
}
