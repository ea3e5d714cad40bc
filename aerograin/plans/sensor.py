"""Queries over the 30-second readings: slots, quality, window means, as-of and interval joins, the fuzzy index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHANNELS, FuzzyConfig, QualityConfig
from ..functions import fuzzy, scores, stats
from ..operators import quality, sequence
from ..sources.adapters import HOURLY, S30, readings_30s, readings_hourly, table

CFG = QualityConfig()
WIDE = ["pm2_5", "pm10", "co2", "temperature", "humidity"]
HISTORY = CFG.hampel_window - 1
SLOTS = CFG.window_min * 60 // CFG.cadence_s
KEYS = ["device", "tick", "channel"]


def matched(spark, sf_dir) -> DataFrame:
    return sequence.slot_match(readings_30s(spark, sf_dir), "device", "ts", CFG.cadence_s, CFG.tolerance_s)


def ticked(spark, sf_dir, readings: DataFrame, window_min: int = CFG.window_min) -> DataFrame:
    """device, tick, slot, is_window and the matched row of `readings`: every window with its history, all ticks at once."""
    ticks = sequence.ticks(readings_30s(spark, sf_dir), "device", "ts", CFG.recompute_min)
    n = window_min * 60 // CFG.cadence_s
    slots = ticks.select("device", "tick", F.explode(F.sequence(F.lit(0), F.lit(n + HISTORY - 1))).alias("k"))
    slots = slots.select("device", "tick", F.expr(f"tick - make_dt_interval(0, 0, 0, cast(k * {CFG.cadence_s} as decimal(18,6)))").alias("slot"), (F.col("k") < n).alias("is_window"))
    return slots.join(readings.withColumn("matched", F.lit(True)), ["device", "slot"], "left")


def expected(spark, sf_dir, window_min: int = CFG.window_min) -> DataFrame:
    return ticked(spark, sf_dir, matched(spark, sf_dir).drop("offset_us"), window_min)


def judged(spark, sf_dir) -> DataFrame:
    """device, slot, cells: of every matched reading once, an entry a channel with its hard state and whether it is an outlier.

    A window's slots have their whole frames within the window and its history, so flags do not depend on the window.
    """
    m = matched(spark, sf_dir)
    pm_ok = quality.pm_ordered([F.col(c) for c in ("pm1", "pm2_5", "pm4", "pm10")], CFG.pm_tolerance)
    m = m.withColumns({f"h_{c}": quality.hard(F.lit(c), F.col(c), F.lit(True), F.col("status"), pm_ok) for c in WIDE})
    m = quality.with_hampel_flags(m, "device", "slot", {c: F.when(F.col(f"h_{c}.state") == "VALID", F.col(c)) for c in WIDE}, CFG.cadence_s, CFG.hampel_window, CFG.hampel_k)
    aux = lambda c: F.array("pm1", "pm4") if c in ("pm2_5", "pm10") else F.lit(None).cast("array<double>")
    second = lambda c: F.col(f"{c}2") if c in ("temperature", "humidity") else F.lit(None).cast("double")
    cells = [F.struct(F.lit(c).alias("channel"), F.col(c).alias("value"), F.col(f"h_{c}.state").alias("state"), F.col(f"h_{c}.reason").alias("reason"), aux(c).alias("aux"), second(c).alias("secondary"), F.col(f"is_outlier_{c}").alias("is_outlier")) for c in WIDE]
    return m.select("device", "slot", F.array(*cells).alias("cells"))


def outdoor_trend(spark, sf_dir) -> DataFrame:
    """device, tick, trend of outdoor pm25, t, rh: sign of the latest value against the latest of an hour before."""
    out = readings_hourly(spark, sf_dir).select(F.col("home").alias("device"), "time", "pm25", "t", "rh")
    ticks = sequence.ticks(readings_30s(spark, sf_dir), "device", "ts", CFG.recompute_min)
    now = sequence.asof(ticks, out, "device", "tick", "time", ["pm25", "t", "rh"], prefix="now_")
    before = now.withColumn("tick1", F.expr("tick - interval 1 hour"))
    both = sequence.asof(before, out, "device", "tick1", "time", ["pm25", "t", "rh"], prefix="old_")
    age = (sequence.micros(F.col("tick")) - sequence.micros(F.col("now_time"))) / 6e7
    return both.select("device", "tick", "now_time", age.alias("age_min"), (age > CFG.outdoor_max_age_min).alias("stale"), *[F.signum(F.col(f"now_{c}") - F.col(f"old_{c}")).alias(f"trend_{c}") for c in ("pm25", "t", "rh")])


def checked(spark, sf_dir) -> DataFrame:
    """Long slot table with the hard state of every channel, and outliers."""
    none = {"value": "double", "state": "string", "reason": "string", "aux": "array<double>", "secondary": "double", "is_outlier": "boolean"}
    gone = {"state": F.lit("MISSING"), "reason": F.lit("data_loss"), "is_outlier": F.lit(False)}
    empty = F.array(*[F.struct(F.lit(c).alias("channel"), *[gone.get(k, F.lit(None).cast(t)).alias(k) for k, t in none.items()]) for c in WIDE])
    e = ticked(spark, sf_dir, judged(spark, sf_dir)).join(outdoor_trend(spark, sf_dir), ["device", "tick"], "left")
    long = e.select("device", "tick", "slot", "is_window", "trend_pm25", "trend_t", "trend_rh", F.inline(F.coalesce("cells", empty)))
    ch = F.col("channel")
    trend = F.when(ch.isin("pm2_5", "pm10"), F.col("trend_pm25")).when(ch == "temperature", F.col("trend_t")).when(ch == "humidity", F.col("trend_rh"))
    # In a window's history the frames reach before its first slot: no outliers there.
    return long.select("device", "tick", "slot", "channel", "value", "is_window", "state", "reason", "aux", "secondary", (F.col("is_outlier") & F.col("is_window")).alias("is_outlier"), trend.alias("trend"))


def softly(spark, sf_dir) -> DataFrame:
    """checked() with the soft verdicts; history slots are sliced off after they served."""
    return quality.soft(checked(spark, sf_dir), KEYS, "slot", CFG).where("is_window")


def aggregated(spark, sf_dir) -> DataFrame:
    x = softly(spark, sf_dir)
    start = F.expr(f"tick - make_dt_interval(0, 0, {CFG.window_min})")
    return quality.time_weighted(x, KEYS, "slot", "x", F.col("usable"), start, F.col("tick"), CFG.coverage_min)


def windows(spark, sf_dir) -> DataFrame:
    """device, tick and the five window means, null where coverage is short."""
    return aggregated(spark, sf_dir).groupBy("device", "tick").pivot("channel", WIDE).agg(F.first("mean"))


def inferred(spark, sf_dir) -> DataFrame:
    return fuzzy.infer(windows(spark, sf_dir))


def slot_match(spark, sf_dir):
    return matched(spark, sf_dir).select("device", "slot", "ts", "offset_us")


def expected_slots(spark, sf_dir):
    e = expected(spark, sf_dir)
    return e.groupBy("device", "tick").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_window").alias("n_window"), F.count_if("matched").alias("n_matched"), F.min("slot").alias("first_slot"))


def outdoor_asof(spark, sf_dir):
    x = outdoor_trend(spark, sf_dir)
    return x.select("device", "tick", "now_time", F.round("age_min", 6).alias("age_min"), "stale", *[F.col(f"trend_{c}") for c in ("pm25", "t", "rh")])


def hard_checks(spark, sf_dir):
    return checked(spark, sf_dir).where("is_window").groupBy("device", "channel", "state", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _flags(spark, sf_dir) -> DataFrame:
    m = matched(spark, sf_dir).select("device", "slot", "co2", "pm2_5")
    return m


def hampel_flags(spark, sf_dir):
    x = quality.with_hampel(_flags(spark, sf_dir), ["device"], "slot", "co2", 11, 3.0)
    return x.select("device", "slot", F.round("hampel_median", 6).alias("hampel_median"), F.round("hampel_mad", 6).alias("hampel_mad"), "is_outlier")


def stuck_values(spark, sf_dir):
    return quality.with_stuck(_flags(spark, sf_dir), ["device"], "slot", "pm2_5", 5).groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_stuck").alias("n_stuck"))


def gradual_drift(spark, sf_dir):
    x = quality.with_drift(_flags(spark, sf_dir), ["device"], "slot", "co2", 3, F.lit(60.0))
    return x.where("is_drift").select("device", "slot", F.round("co2", 6).alias("co2"))


def soft_checks(spark, sf_dir):
    return softly(spark, sf_dir).groupBy("device", "channel", "stage2", F.concat_ws(";", "reasons").alias("reasons"), F.coalesce(F.col("confirmed").cast("string"), F.lit("")).alias("confirmed")).agg(F.count(F.lit(1)).alias("n"), F.count_if("usable").alias("n_usable"))


def window_means(spark, sf_dir):
    return aggregated(spark, sf_dir).select("device", "tick", "channel", "n_expected", "n_usable", F.round("coverage", 6).alias("coverage"), "ok", F.round("mean", 6).alias("mean"))


def window_completeness(spark, sf_dir):
    x = quality.completeness(aggregated(spark, sf_dir), ["device", "tick"])
    return x.select("device", "tick", "status", F.concat_ws(";", "missing_components").alias("missing_components"), F.concat_ws(";", "missing_inputs").alias("missing_inputs"))


def status_counts(spark, sf_dir):
    """Windows per completeness status and the share of each, with Wilson bounds."""
    x = quality.completeness(aggregated(spark, sf_dir), ["device", "tick"])
    n = x.groupBy("device", "status").agg(F.count(F.lit(1)).alias("k")).withColumn("n", F.sum("k").over(Window.partitionBy("device")))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return n.select("device", "status", "k", "n", F.round(F.col("k") / F.col("n"), 6).alias("share"), F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


def partial_intervals(spark, sf_dir):
    """Stretches of windows in one status other than OK."""
    x = quality.completeness(aggregated(spark, sf_dir), ["device", "tick"])
    g = sequence.islands(x, "device", "tick", sequence.changed(F.col("status"), "device", "tick"))
    return g.where("status <> 'OK'").groupBy("device", "island", "status").agg(F.min("tick").alias("start"), F.max("tick").alias("end"), F.count(F.lit(1)).alias("n")).drop("island")


def coverage_sweep(spark, sf_dir):
    """Windows kept at three coverage thresholds: the threshold is a column, nothing is computed again."""
    a = aggregated(spark, sf_dir).withColumn("threshold", F.explode(F.array(F.lit(0.7), F.lit(0.8), F.lit(0.9))))
    return a.groupBy("channel", "threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("coverage") >= F.col("threshold")).alias("n_ok"))


def reason_frequency(spark, sf_dir):
    """Reasons exploded: rows and share by channel and hour, one row a reason."""
    x = softly(spark, sf_dir).select("channel", F.hour("slot").alias("hour"), F.explode("reasons").alias("reason"))
    return x.groupBy("channel", "hour", "reason").agg(F.count(F.lit(1)).alias("n"))


def latest_quality(spark, sf_dir):
    """Each slot's verdict from the last window that covers it (last writer wins), without storing the others."""
    x = softly(spark, sf_dir)
    y = x.groupBy("device", "slot", "channel").agg(F.max_by(F.struct("stage2", "usable"), "tick").alias("v"))
    return y.groupBy("device", "channel", F.col("v.stage2").alias("stage2")).agg(F.count(F.lit(1)).alias("n"), F.count_if("v.usable").alias("n_usable"))


def locf_values(spark, sf_dir):
    """CO2 carried from the last good reading strictly before, at most ten minutes old."""
    x = readings_30s(spark, sf_dir).withColumn("good", F.lower("status") == "ok")
    y = sequence.locf(x, "device", "ts", "co2", 600_000_000, F.col("good"), "co2_last")
    return y.where("not good").select("device", "ts", F.round("co2_last", 6).alias("co2_last"), "co2_last_time")


def events_by_user(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    spans = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("start"), F.expr("ts + interval 2 hours").alias("end"), F.col("event_id").alias("span_id"))
    return e, spans


def points_in_intervals(spark, sf_dir):
    """Events inside two hours of a purchase of the same user: a bucketed semi-join."""
    e, spans = events_by_user(spark, sf_dir)
    got = sequence.within_intervals(e.where("event_type <> 'purchase'"), spans.drop("span_id"), "user_id", "ts", "start", "end", 7_200_000_000)
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def interval_instances(spark, sf_dir):
    """Per purchase: rows inside its two hours, whether one is an error, and the delay to the first view."""
    e, spans = events_by_user(spark, sf_dir)
    got = sequence.within_intervals(e.where("event_type <> 'purchase'").select("user_id", "ts", "event_type"), spans, "user_id", "ts", "start", "end", 7_200_000_000, "inner")
    one = got.groupBy(F.col("ev_span_id").alias("span_id")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("event_type") == "error").alias("any_error"), F.min(F.when(F.col("event_type") == "view", sequence.micros(F.col("ts")) - sequence.micros(F.col("ev_start")))).alias("delay_us"))
    return spans.select("span_id").join(one, "span_id", "left").select("span_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("any_error", F.lit(False)).alias("any_error"), "delay_us")


def overlapping_intervals(spark, sf_dir):
    e, spans = events_by_user(spark, sf_dir)
    other = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("start"), F.expr("ts + interval 1 hour").alias("end"))
    return sequence.overlapping(spans, other, "user_id", 7_200_000_000).select("span_id")


def asof_events(spark, sf_dir):
    """Each purchase with the user's latest view at or before it."""
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), "value")
    got = sequence.asof(left, right, "user_id", "ts", "view_ts", ["value"])
    return got.select("event_id", "view_ts", F.round("value", 6).alias("value"))


def user_sessions(spark, sf_dir):
    """Sessions of a user's events with gaps up to six hours."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = e.withColumn("new", sequence.micros(F.col("ts")) - sequence.micros(F.lag("ts").over(w)) > 21_600_000_000).withColumn("s", F.sum(F.when(F.col("new"), 1).otherwise(0)).over(w))
    return g.groupBy("user_id", "s").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("largest"))


def fuzzy_index(spark, sf_dir):
    x = inferred(spark, sf_dir)
    return x.select("device", "tick", "status", *[F.round(c, 5).alias(c) for c in ("score_A", "score_V", "score_M", "index_value")], "rules_fired")


def dominant_component(spark, sf_dir):
    return inferred(spark, sf_dir).select("device", "tick", "status", "index_class", F.coalesce("dominant", F.lit("")).alias("dominant"), F.concat_ws(";", "co_dominant").alias("co_dominant"))


def with_baselines(x: DataFrame, cfg: FuzzyConfig | None = None) -> DataFrame:
    """fuzzy_max, weighted_mean and crisp_class_max beside the index, with severities."""
    cfg = cfg or FuzzyConfig()
    there = [F.col(f"score_{c}") for c in "AVM"]
    n = sum((c.isNotNull().cast("int") for c in there[1:]), there[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in there[1:]), F.coalesce(there[0], F.lit(0.0)))
    a = F.when(F.col("pm2_5").isNotNull() & F.col("pm10").isNotNull(), F.greatest(scores.hard_class(F.col("pm2_5"), cfg.pm2_5[0]), scores.hard_class(F.col("pm10"), cfg.pm10[0])))
    v = scores.hard_class(F.col("co2"), cfg.co2[0])
    m = F.when(F.col("temperature").isNotNull() & F.col("humidity").isNotNull(), F.greatest(scores.hard_class_two_sided(F.col("temperature"), cfg.temperature[0]), scores.hard_class_two_sided(F.col("humidity"), cfg.humidity[0])))
    out = x.withColumns({"fuzzy_max": F.greatest(*there), "weighted_mean": F.when(n > 0, total / n), "crisp": F.greatest(a, v, m)})
    out = out.withColumn("crisp_value", F.col("crisp") * 25.0 + 12.5)
    sev = lambda c: scores.severity(scores.output_class(F.round(c, 9)))  # noqa: E731 (a mean of 50 is 50 in any order of its terms)
    return out.withColumns({"sev_two_level": sev("index_value"), "sev_fmax": sev("fuzzy_max"), "sev_mean": sev("weighted_mean")})


def baselines(spark, sf_dir):
    x = with_baselines(inferred(spark, sf_dir))
    return x.select("device", "tick", *[F.round(c, 5).alias(c) for c in ("fuzzy_max", "weighted_mean", "crisp_value")], "crisp")


METHODS = {"TWO_LEVEL": "sev_two_level", "FUZZY_MAX": "sev_fmax", "CRISP_MAX": "crisp", "MEAN": "sev_mean"}


def method_agreement(spark, sf_dir):
    """All six pairs of methods: agreement, kappa, macro F1, rows left out for a null class. Pairs are stacked, one pass."""
    x = with_baselines(inferred(spark, sf_dir))
    names = list(METHODS)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows = ", ".join(f"'{a}', '{b}', {METHODS[a]}, {METHODS[b]}" for a, b in pairs)
    long = x.select(F.expr(f"stack({len(pairs)}, {rows}) as (method_a, method_b, a, b)"))
    got = stats.agreement(long, ["method_a", "method_b"], "a", "b", 4)
    return got.select("method_a", "method_b", "n", "n_excluded", *[F.round(c, 6).alias(c) for c in ("agreement", "kappa", "macro_f1")])


def masking(spark, sf_dir):
    """Windows where a component is critical, and how many of them each method shows as less."""
    x = with_baselines(inferred(spark, sf_dir)).where(F.round(F.greatest("score_A", "score_V", "score_M"), 9) >= 75)
    rows = ", ".join(f"'{m}', {c}" for m, c in METHODS.items())
    long = x.select(F.expr(f"stack({len(METHODS)}, {rows}) as (method, sev)"))
    return long.groupBy("method").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.coalesce("sev", F.lit(-1)) < 3).alias("n_masked")).withColumn("rate", F.round(F.col("n_masked") / F.col("n_events"), 6))


LOOKBACKS = (5, 10, 15, 30)


def missing_data_strategies(spark, sf_dir):
    """Every good CO2 reading taken as missing in turn and estimated from what came before: last value within 5 to 30 minutes,
    and the mean of the last 15. Share that has an estimate, errors, under- and overestimates. All frames share one sort."""
    x = readings_30s(spark, sf_dir).where(F.lower("status") == "ok")
    us = sequence.micros(F.col("ts"))
    frame = lambda m: Window.partitionBy("device").orderBy(us).rangeBetween(-m * 60_000_000, -1)
    x = x.withColumns({**{f"locf_{m}": F.last("co2").over(frame(m)) for m in LOOKBACKS}, "mean_15": F.avg("co2").over(frame(15))})
    names = [f"locf_{m}" for m in LOOKBACKS] + ["mean_15"]
    long = x.select("co2", F.expr(f"stack({len(names)}, {', '.join(f"'{n}', {n}" for n in names)}) as (strategy, estimate)"))
    e = F.col("estimate") - F.col("co2")
    way = scores.estimation_direction(F.round("estimate", 6), F.round("co2", 6))
    return long.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.round(F.count("estimate") / F.count(F.lit(1)), 6).alias("coverage"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.count_if(way == "under").alias("n_under"), F.count_if(way == "over").alias("n_over"))


QUERIES = {f.__name__: f for f in (missing_data_strategies, slot_match, expected_slots, outdoor_asof, hard_checks, hampel_flags, stuck_values, gradual_drift, soft_checks, window_means, window_completeness, status_counts, partial_intervals, coverage_sweep, reason_frequency, latest_quality, locf_values, points_in_intervals, interval_instances, overlapping_intervals, asof_events, user_sessions, fuzzy_index, dominant_component, baselines, method_agreement, masking)}

# --- SQL -------------------------------------------------------------------------------------------------------------

_MATCH = f"""{S30},
cand0 AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) // 30000000 * 30000000 AS low FROM readings30),
cand AS (SELECT *, low AS s FROM cand0 WHERE us - low <= 15000000 UNION ALL SELECT *, low + 30000000 FROM cand0 WHERE low + 30000000 - us <= 15000000),
m1 AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY device, s ORDER BY abs(us - s), ts) = 1),
m2 AS (SELECT * FROM m1 QUALIFY row_number() OVER (PARTITION BY device, ts ORDER BY abs(us - s), s) = 1),
matched AS (SELECT *, make_timestamp(s) AS slot, us - s AS offset_us FROM m2)"""
_TICKS = """tk AS (SELECT device, min(epoch_us(ts)) // 300000000 AS a, max(epoch_us(ts)) // 300000000 AS b FROM readings30 GROUP BY device),
ticks AS (SELECT device, make_timestamp(unnest(range(a + 1, b + 1)) * 300000000) AS tick FROM tk)"""
_EXPECT = f"""{_MATCH}, {_TICKS},
sl AS (SELECT device, tick, unnest(range(0, {SLOTS + HISTORY})) AS k FROM ticks),
expected AS (SELECT sl.device, sl.tick, sl.tick - to_seconds(sl.k * 30) AS slot, sl.k < {SLOTS} AS is_window, m.* EXCLUDE (device, slot), m.device IS NOT NULL AS is_matched
  FROM sl LEFT JOIN matched m ON m.device = sl.device AND m.slot = sl.tick - to_seconds(sl.k * 30))"""
_TREND = f"""{HOURLY}, outd AS (SELECT home AS device, time, pm25, t, rh FROM readings),
now_ AS (SELECT k.device, k.tick, o.time, o.pm25, o.t, o.rh FROM ticks k ASOF LEFT JOIN outd o ON k.device = o.device AND k.tick >= o.time),
old_ AS (SELECT k.device, k.tick, o.pm25, o.t, o.rh FROM (SELECT device, tick, tick - INTERVAL 1 HOUR AS t1 FROM ticks) k ASOF LEFT JOIN outd o ON k.device = o.device AND k.t1 >= o.time),
trend AS (SELECT n.device, n.tick, n.time AS now_time, epoch_us(n.tick - n.time) / 6e7::DOUBLE AS age_min, sign(n.pm25 - o.pm25)::DOUBLE AS trend_pm25, sign(n.t - o.t)::DOUBLE AS trend_t, sign(n.rh - o.rh)::DOUBLE AS trend_rh
  FROM now_ n JOIN old_ o USING (device, tick))"""
_RANGE = lambda c: f"{c} BETWEEN {CHANNELS[c][0]} AND {CHANNELS[c][1]}"
_AUX = {"pm2_5": ("pm1, pm4", "NULL", "trend_pm25"), "pm10": ("pm1, pm4", "NULL", "trend_pm25"), "co2": (None, "NULL", "NULL"), "temperature": (None, "temperature2", "trend_t"), "humidity": (None, "humidity2", "trend_rh")}


def _channel(c: str) -> str:
    aux, second, trend = _AUX[c]
    order = "WHEN NOT pm_ok THEN 'INVALID' " if c.startswith("pm") else ""
    return f"""SELECT device, tick, slot, '{c}' AS channel, {c} AS value, is_window,
 CASE WHEN NOT is_matched THEN 'MISSING' WHEN lower(status) IN ('disabled', 'data_not_ready') THEN 'MISSING' WHEN lower(status) = 'failed' THEN 'INVALID'
  WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 'INVALID' WHEN NOT ({_RANGE(c)}) THEN 'INVALID' {order}ELSE 'VALID' END AS state,
 {'pm1' if aux else 'NULL::DOUBLE'} AS aux1, {'pm4' if aux else 'NULL::DOUBLE'} AS aux2, {second}::DOUBLE AS secondary, {trend}::DOUBLE AS trend FROM ordered"""


_CHECKED = f"""{_EXPECT}, {_TREND},
ordered AS (SELECT e.*, CASE WHEN pm1 IS NULL OR pm2_5 IS NULL OR pm4 IS NULL OR pm10 IS NULL THEN true ELSE pm1 <= pm2_5 + abs(pm2_5) * 0.2 AND pm2_5 <= pm4 + abs(pm4) * 0.2 AND pm4 <= pm10 + abs(pm10) * 0.2 END AS pm_ok, trend_pm25, trend_t, trend_rh FROM expected e LEFT JOIN trend USING (device, tick)),
checked0 AS ({' UNION ALL '.join(_channel(c) for c in WIDE)}),
checked AS (SELECT *, CASE state WHEN 'MISSING' THEN 'data_loss' WHEN 'INVALID' THEN 'out_of_range' END AS reason FROM checked0)"""
_P = "PARTITION BY device, tick, channel"
_LEAST = " ".join(f"WHEN '{c}' THEN {3.0 * v[2]}" for c, v in CHANNELS.items())
_SOFT = f"""{_CHECKED},
q0 AS (SELECT *, CASE WHEN state = 'VALID' THEN value END AS x FROM checked),
q1 AS (SELECT *, list(x) FILTER (x IS NOT NULL) OVER ({_P} ORDER BY slot ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS l, lag(x) OVER ({_P} ORDER BY slot) AS prev,
  first_value(x IGNORE NULLS) OVER ({_P} ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x0,
  lag(aux1) OVER ({_P} ORDER BY slot) AS p1, lag(aux2) OVER ({_P} ORDER BY slot) AS p2 FROM q0),
q2 AS (SELECT *, CASE WHEN len(l) = 11 AND x IS NOT NULL THEN list_aggregate(l, 'median') END AS med, sign(x - prev) AS s, CASE WHEN x = prev THEN 0 ELSE 1 END AS fresh FROM q1),
q3 AS (SELECT *, CASE WHEN med IS NOT NULL THEN list_aggregate(list_transform(l, lambda y: abs(y - med)), 'median') * 1.4826 END AS mad, sum(fresh) OVER ({_P} ORDER BY slot) AS sg,
  sum(CASE WHEN s IS NULL OR s = 0 OR s IS DISTINCT FROM prev_s THEN 1 ELSE 0 END) OVER ({_P} ORDER BY slot) AS dg FROM (SELECT *, lag(s) OVER ({_P} ORDER BY slot) AS prev_s FROM q2)),
q4 AS (SELECT *, coalesce(CASE WHEN mad > 0 THEN abs(x - med) > 3.0 * mad ELSE x <> med END, false) AS is_outlier,
  count(*) OVER (PARTITION BY device, tick, channel, sg) >= 5 AND x IS NOT NULL AS is_stuck,
  coalesce(s <> 0 AND row_number() OVER (PARTITION BY device, tick, channel, dg ORDER BY slot) >= 5 AND abs(x - first_value(prev) OVER (PARTITION BY device, tick, channel, dg ORDER BY slot)) >= CASE channel {_LEAST} END, false) AS is_drift FROM q3),
q5 AS (SELECT *, is_outlier OR is_stuck OR is_drift AS suspect FROM q4),
q6 AS (SELECT *, sum(CASE WHEN (suspect AND coalesce(prev_sus, false)) OR NOT suspect THEN 0 ELSE 1 END) OVER ({_P} ORDER BY slot) AS pg FROM (SELECT *, lag(suspect) OVER ({_P} ORDER BY slot) AS prev_sus FROM q5)),
q7 AS (SELECT *, suspect AND count(*) OVER (PARTITION BY device, tick, channel, pg) >= 2 AS persists,
  coalesce(s <> 0 AND (sign(aux1 - p1) = s OR sign(aux2 - p2) = s), false) AS moves, coalesce(trend <> 0 AND sign(x - x0) = trend, false) AS trends,
  coalesce(abs(x - secondary) <= CASE channel WHEN 'temperature' THEN 1.3 ELSE 9.0 END, false) AS near_ FROM q6),
q8 AS (SELECT *, persists AND CASE WHEN channel IN ('pm2_5', 'pm10') THEN moves OR trends WHEN channel = 'co2' THEN true ELSE near_ OR trends END AS okay FROM q7),
soft AS (SELECT *, CASE WHEN state <> 'VALID' THEN state WHEN suspect THEN 'SUSPECT' ELSE 'VALID' END AS stage2, state = 'VALID' AND (NOT suspect OR okay) AS usable,
  CASE WHEN state = 'VALID' AND suspect THEN okay END AS confirmed,
  CASE WHEN state <> 'VALID' THEN [reason] WHEN suspect THEN list_filter([CASE WHEN is_stuck THEN 'stuck_value' END, CASE WHEN is_drift THEN 'gradual_drift' END, CASE WHEN is_outlier AND NOT is_stuck THEN 'single_spike' END], lambda z: z IS NOT NULL) ELSE []::VARCHAR[] END AS reasons
  FROM q8 WHERE is_window)"""
_AGG = f"""{_SOFT},
n_ AS (SELECT device, tick, channel, count(*) AS n_expected, count_if(usable)::BIGINT AS n_usable FROM soft GROUP BY ALL),
t0 AS (SELECT device, tick, channel, x, epoch_us(slot) AS t, epoch_us(tick) AS b, epoch_us(tick) - 900000000 AS a FROM soft WHERE usable AND x IS NOT NULL),
t1 AS (SELECT *, greatest(coalesce((t + lead(t) OVER w) / 2::DOUBLE, b) - coalesce((lag(t) OVER w + t) / 2::DOUBLE, a), 0.0) AS d FROM t0 WINDOW w AS ({_P} ORDER BY t)),
t2 AS (SELECT device, tick, channel, count(*) AS k, any_value(x) AS one, sum(d * x) AS m, sum(d) AS w FROM t1 GROUP BY ALL),
agg AS (SELECT n_.*, n_usable / n_expected::DOUBLE AS coverage, n_usable / n_expected::DOUBLE >= 0.8 AS ok,
  CASE WHEN n_usable / n_expected::DOUBLE >= 0.8 THEN CASE WHEN k = 1 THEN one WHEN w > 0 THEN m / w END END AS mean FROM n_ LEFT JOIN t2 USING (device, tick, channel))"""
_DONE = f"""{_AGG},
c0 AS (SELECT device, tick, list_sort(list(channel) FILTER (NOT ok)) AS bad, list(channel) FILTER (ok) AS good FROM agg GROUP BY ALL),
c1 AS (SELECT *, list_filter([CASE WHEN NOT list_has_all(coalesce(good, []::VARCHAR[]), ['pm2_5', 'pm10']) THEN 'A' END, CASE WHEN NOT list_has_all(coalesce(good, []::VARCHAR[]), ['temperature', 'humidity']) THEN 'M' END, CASE WHEN NOT list_has_all(coalesce(good, []::VARCHAR[]), ['co2']) THEN 'V' END], lambda z: z IS NOT NULL) AS gone FROM c0),
complete AS (SELECT *, CASE len(gone) WHEN 0 THEN 'OK' WHEN 1 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM c1)"""

SQL = {
    "slot_match": f"WITH {_MATCH} SELECT device, slot, ts, offset_us FROM matched",
    "expected_slots": f"WITH {_EXPECT} SELECT device, tick, count(*) AS n, count_if(is_window)::BIGINT AS n_window, count_if(is_matched)::BIGINT AS n_matched, min(slot) AS first_slot FROM expected GROUP BY ALL",
    "outdoor_asof": f"WITH {S30}, {_TICKS}, {_TREND} SELECT device, tick, now_time, round(age_min, 6) AS age_min, age_min > 120 AS stale, trend_pm25, trend_t, trend_rh FROM trend",
    "hard_checks": f"WITH {_CHECKED} SELECT device, channel, state, coalesce(reason, '') AS reason, count(*) AS n FROM checked WHERE is_window GROUP BY ALL",
    "hampel_flags": f"""WITH {_MATCH}, l AS (SELECT device, slot, co2 AS x, list(co2) OVER (PARTITION BY device ORDER BY slot ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS l FROM matched),
a AS (SELECT *, CASE WHEN len(l) = 11 THEN list_aggregate(l, 'median') END AS med FROM l), b AS (SELECT *, CASE WHEN med IS NOT NULL THEN list_aggregate(list_transform(l, lambda y: abs(y - med)), 'median') * 1.4826 END AS mad FROM a)
SELECT device, slot, round(med, 6) AS hampel_median, round(mad, 6) AS hampel_mad, coalesce(CASE WHEN mad > 0 THEN abs(x - med) > 3.0 * mad ELSE x <> med END, false) AS is_outlier FROM b""",
    "stuck_values": f"""WITH {_MATCH}, a AS (SELECT device, slot, pm2_5 AS x, CASE WHEN pm2_5 = lag(pm2_5) OVER (PARTITION BY device ORDER BY slot) THEN 0 ELSE 1 END AS f FROM matched), b AS (SELECT *, sum(f) OVER (PARTITION BY device ORDER BY slot) AS g FROM a),
c AS (SELECT *, count(*) OVER (PARTITION BY device, g) >= 5 AND x IS NOT NULL AS s FROM b) SELECT device, count(*) AS n, count_if(s)::BIGINT AS n_stuck FROM c GROUP BY device""",
    "gradual_drift": f"""WITH {_MATCH}, a AS (SELECT device, slot, co2 AS x, lag(co2) OVER (PARTITION BY device ORDER BY slot) AS prev FROM matched), b AS (SELECT *, sign(x - prev) AS s FROM a),
c AS (SELECT *, lag(s) OVER (PARTITION BY device ORDER BY slot) AS ps FROM b), d AS (SELECT *, sum(CASE WHEN s IS NULL OR s = 0 OR s IS DISTINCT FROM ps THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY slot) AS g FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY device, g ORDER BY slot) AS n, first_value(prev) OVER (PARTITION BY device, g ORDER BY slot) AS b0 FROM d)
SELECT device, slot, round(x, 6) AS co2 FROM e WHERE s <> 0 AND n >= 3 AND abs(x - b0) >= 60""",
    "soft_checks": f"WITH {_SOFT} SELECT device, channel, stage2, array_to_string(reasons, ';') AS reasons, coalesce(confirmed::VARCHAR, '') AS confirmed, count(*) AS n, count_if(usable)::BIGINT AS n_usable FROM soft GROUP BY ALL",
    "window_means": f"WITH {_AGG} SELECT device, tick, channel, n_expected, n_usable, round(coverage, 6) AS coverage, ok, round(mean, 6) AS mean FROM agg",
    "window_completeness": f"WITH {_DONE} SELECT device, tick, status, array_to_string(gone, ';') AS missing_components, coalesce(array_to_string(bad, ';'), '') AS missing_inputs FROM complete",
    "status_counts": f"""WITH {_DONE}, k AS (SELECT device, status, count(*) AS k FROM complete GROUP BY ALL), s AS (SELECT *, sum(k) OVER (PARTITION BY device)::BIGINT AS n FROM k),
p AS (SELECT *, k / n::DOUBLE AS p, 1.96 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n) AS h, (k / n::DOUBLE + 3.8416 / (2.0 * n)) / (1 + 3.8416 / n) AS c FROM s)
SELECT device, status, k, n, round(p, 6) AS share, round(greatest(0.0, c - h), 6) AS low, round(least(1.0, c + h), 6) AS high FROM p""",
    "partial_intervals": f"""WITH {_DONE}, a AS (SELECT device, tick, status, status IS DISTINCT FROM lag(status) OVER (PARTITION BY device ORDER BY tick) AS new FROM complete), b AS (SELECT *, sum(new::INT) OVER (PARTITION BY device ORDER BY tick) AS g FROM a)
SELECT device, status, min(tick) AS start, max(tick) AS "end", count(*) AS n FROM b WHERE status <> 'OK' GROUP BY device, g, status""",
    "coverage_sweep": f"WITH {_AGG} SELECT channel, threshold, count(*) AS n, count_if(coverage >= threshold)::BIGINT AS n_ok FROM agg CROSS JOIN (SELECT unnest([0.7::DOUBLE, 0.8, 0.9]) AS threshold) GROUP BY ALL",
    "reason_frequency": f"WITH {_SOFT}, e AS (SELECT channel, hour(slot)::INT AS hour, unnest(reasons) AS reason FROM soft) SELECT channel, hour, reason, count(*) AS n FROM e GROUP BY ALL",
    "latest_quality": f"WITH {_SOFT}, l AS (SELECT * FROM soft QUALIFY row_number() OVER (PARTITION BY device, slot, channel ORDER BY tick DESC) = 1) SELECT device, channel, stage2, count(*) AS n, count_if(usable)::BIGINT AS n_usable FROM l GROUP BY ALL",
    "locf_values": f"""WITH {S30}, b AS (SELECT device, ts FROM readings30 WHERE lower(status) <> 'ok'), g AS (SELECT device, ts, co2 FROM readings30 WHERE lower(status) = 'ok'),
j AS (SELECT b.device, b.ts, g.ts AS t, g.co2 FROM b ASOF LEFT JOIN g ON b.device = g.device AND b.ts > g.ts)
SELECT device, ts, CASE WHEN ts - t <= INTERVAL 10 MINUTE THEN round(co2, 6) END AS co2_last, CASE WHEN ts - t <= INTERVAL 10 MINUTE THEN t END AS co2_last_time FROM j""",
    "points_in_intervals": "SELECT event_type, count(*) AS n FROM events e WHERE event_type <> 'purchase' AND EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND e.ts >= p.ts AND e.ts <= p.ts + INTERVAL 2 HOUR) GROUP BY event_type",
    "interval_instances": """SELECT p.event_id AS span_id, count(e.event_id) AS n, coalesce(bool_or(e.event_type = 'error'), false) AS any_error, min(CASE WHEN e.event_type = 'view' THEN epoch_us(e.ts) - epoch_us(p.ts) END) AS delay_us
FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type <> 'purchase') e ON p.user_id = e.user_id AND e.ts >= p.ts AND e.ts <= p.ts + INTERVAL 2 HOUR GROUP BY p.event_id""",
    "overlapping_intervals": "SELECT event_id AS span_id FROM events p WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.user_id = p.user_id AND p.ts < e.ts + INTERVAL 1 HOUR AND p.ts + INTERVAL 2 HOUR > e.ts)",
    "asof_events": """WITH v AS (SELECT user_id, ts AS view_ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT p.event_id, v.view_ts, round(v.value, 6) AS value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.view_ts""",
    "user_sessions": """WITH a AS (SELECT user_id, ts, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 21600000000 AS new FROM events), b AS (SELECT *, sum(coalesce(new, false)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM a),
c AS (SELECT user_id, s, count(*) AS n FROM b GROUP BY ALL) SELECT user_id, count(*) AS n_sessions, max(n) AS largest FROM c GROUP BY user_id""",
}


def _trap(x: str, s: tuple) -> str:
    a, b, c, d = s
    up = "1.0::DOUBLE" if b == float("-inf") else f"({x} - ({a})) / ({b - a}::DOUBLE)"
    down = "1.0::DOUBLE" if c == float("inf") else f"(({d}) - {x}) / ({d - c}::DOUBLE)"
    return f"greatest(0.0::DOUBLE, least({up}, 1.0::DOUBLE, {down}))"


def _members(x: str, shapes: list) -> list[str]:
    return [f"CASE WHEN {x} IS NOT NULL THEN greatest({', '.join(_trap(x, s) for s in shape)}) END" if len(shape) > 1 else f"CASE WHEN {x} IS NOT NULL THEN {_trap(x, shape[0])} END" for shape in shapes]


def _centre(src: str, cols: list[str], name: str, key: str) -> str:
    """CTE {name}: {key}, c = centroid of the four columns, over the universe cross-joined."""
    curves = [_trap("u", s[0]) for s in fuzzy.monotonic_shapes(*FuzzyConfig().output)]
    mu = f"greatest({', '.join(f'least({c}, coalesce({a}, 0.0))' for c, a in zip(curves, cols, strict=True))})"
    return f"{name} AS (SELECT {key}, sum(u * mu) / nullif(sum(mu), 0) AS c FROM (SELECT {key}, u, {mu} AS mu FROM {src} CROSS JOIN uni) GROUP BY {key})"


def fuzzy_ctes(source: str, key: str) -> str:
    """CTEs ending in `hf`: {key}, inputs, score_A, score_V, score_M, index_value, status, rules_fired: all rules listed and joined."""
    f = FuzzyConfig()
    parts = {"pm2_5": fuzzy.monotonic_shapes(*f.pm2_5), "pm10": fuzzy.monotonic_shapes(*f.pm10), "co2": fuzzy.monotonic_shapes(*f.co2), "temperature": fuzzy.two_sided_shapes(*f.temperature), "humidity": fuzzy.two_sided_shapes(*f.humidity)}
    mem = ", ".join(f"{e} AS {c}_{i}" for c, s in parts.items() for i, e in enumerate(_members(c, s)))

    def pair(a: str, b: str, n: str) -> str:
        rules = {s: [f"least({a}_{i}, {b}_{j})" for i in range(4) for j in range(4) if max(i, j) == s] for s in range(4)}
        return ", ".join(f"CASE WHEN {a}_0 IS NOT NULL AND {b}_0 IS NOT NULL THEN greatest({', '.join(r)}) END AS {n}{s}" for s, r in rules.items())

    comp = {}
    for s in range(4):
        for have in ("AVM", "AV", "AM", "VM", "A", "V", "M"):
            rows = [[]]
            for n in have:
                rows = [r + [(n, i)] for r in rows for i in range(4)]
            comp[s, have] = [f"least({', '.join(f'{n}{i}' for n, i in r)})" for r in rows if max(i for _, i in r) == s]
    case = lambda s: "CASE " + " ".join(f"WHEN {' AND '.join(f'{n}0 IS {'NOT ' if n in have else ''}NULL' for n in 'AVM')} THEN greatest({', '.join(comp[s, have])})" for have in ("AVM", "AV", "AM", "VM", "A", "V", "M")) + " END"
    fires = " * ".join(f"CASE WHEN {n}0 IS NULL THEN 1 ELSE {' + '.join(f'({n}{s} > 0)::INT' for s in range(4))} END" for n in "AVM")
    return f"""uni AS (SELECT i * 0.25::DOUBLE AS u FROM (SELECT unnest(range(0, 401)) AS i)), hm AS (SELECT *, {mem} FROM {source}),
hc AS (SELECT *, {pair('pm2_5', 'pm10', 'A')}, {', '.join(f'co2_{s} AS V{s}' for s in range(4))}, {pair('temperature', 'humidity', 'M')} FROM hm),
ho AS (SELECT *, {', '.join(f'{case(s)} AS o{s}' for s in range(4))}, {fires} AS rules_fired, (A0 IS NULL)::INT + (V0 IS NULL)::INT + (M0 IS NULL)::INT AS n_gone FROM hc),
{_centre('ho', ['A0', 'A1', 'A2', 'A3'], 'ca', key)}, {_centre('ho', ['V0', 'V1', 'V2', 'V3'], 'cv', key)}, {_centre('ho', ['M0', 'M1', 'M2', 'M3'], 'cm', key)}, {_centre('ho', ['o0', 'o1', 'o2', 'o3'], 'ci', key)},
hf AS (SELECT ho.*, CASE WHEN A0 IS NOT NULL THEN coalesce(ca.c, 0.0) END AS "score_A", CASE WHEN V0 IS NOT NULL THEN coalesce(cv.c, 0.0) END AS "score_V", CASE WHEN M0 IS NOT NULL THEN coalesce(cm.c, 0.0) END AS "score_M",
  CASE WHEN n_gone < 2 THEN ci.c END AS index_value, CASE n_gone WHEN 0 THEN 'OK' WHEN 1 THEN 'PARTIAL' ELSE 'FAILED' END AS status
  FROM ho JOIN ca USING ({key}) JOIN cv USING ({key}) JOIN cm USING ({key}) JOIN ci USING ({key}))"""


def _hard(x: str, b: tuple) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < {b[0]} THEN 0 WHEN {x} < {b[1]} THEN 1 WHEN {x} < {b[2]} THEN 2 ELSE 3 END"


def _hard2(x: str, e: tuple) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} BETWEEN {e[2]} AND {e[3]} THEN 0 WHEN {x} BETWEEN {e[1]} AND {e[4]} THEN 1 WHEN {x} BETWEEN {e[0]} AND {e[5]} THEN 2 ELSE 3 END"


def sev_sql(x: str) -> str:
    x = f"round({x}, 9)"
    return f"CASE WHEN {x} < 25 THEN 0 WHEN {x} < 50 THEN 1 WHEN {x} < 75 THEN 2 WHEN {x} >= 75 THEN 3 END"


def baseline_cte() -> str:
    f = FuzzyConfig()
    a = f"CASE WHEN pm2_5 IS NOT NULL AND pm10 IS NOT NULL THEN greatest({_hard('pm2_5', f.pm2_5[0])}, {_hard('pm10', f.pm10[0])}) END"
    m = f"CASE WHEN temperature IS NOT NULL AND humidity IS NOT NULL THEN greatest({_hard2('temperature', f.temperature[0])}, {_hard2('humidity', f.humidity[0])}) END"
    return f"""b0 AS (SELECT *, greatest("score_A", "score_V", "score_M") AS fuzzy_max, (coalesce("score_A", 0) + coalesce("score_V", 0) + coalesce("score_M", 0)) / nullif(3 - n_gone, 0) AS weighted_mean, greatest({a}, {_hard('co2', f.co2[0])}, {m}) AS crisp FROM hf),
bl AS (SELECT *, crisp * 25.0 + 12.5 AS crisp_value, {sev_sql('index_value')} AS sev_two_level, {sev_sql('fuzzy_max')} AS sev_fmax, {sev_sql('weighted_mean')} AS sev_mean FROM b0)"""


def agreement_sql(rows: str, keys: str) -> str:
    cls = range(4)
    cnt = ", ".join(f"count_if(ok AND a = {c})::DOUBLE AS a{c}, count_if(ok AND b = {c})::DOUBLE AS b{c}, count_if(ok AND a = {c} AND b = {c})::DOUBLE AS t{c}" for c in cls)
    f1 = " + ".join(f"CASE WHEN a{c} + b{c} = 0 THEN 1.0 ELSE 2 * t{c} / (a{c} + b{c}) END" for c in cls)
    return f"""ag0 AS (SELECT *, a IS NOT NULL AND b IS NOT NULL AS ok FROM ({rows})), ag1 AS (SELECT {keys}, count_if(ok)::BIGINT AS n, count_if(NOT ok)::BIGINT AS n_excluded, count_if(ok AND a = b)::DOUBLE AS hit, {cnt} FROM ag0 GROUP BY {keys}),
ag2 AS (SELECT *, hit / nullif(n, 0) AS po, ({' + '.join(f'a{c} * b{c}' for c in cls)}) / nullif(n::DOUBLE * n, 0) AS pe, ({f1}) / 4 AS f1 FROM ag1)
SELECT {keys}, n, n_excluded, round(po, 6) AS agreement, round(CASE WHEN pe >= 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa, CASE WHEN n > 0 THEN round(f1, 6) END AS macro_f1 FROM ag2"""


_WIDE_SQL = f"""{_AGG}, win AS (SELECT device, tick, {', '.join(f"any_value(mean) FILTER (channel = '{c}') AS {c}" for c in WIDE)} FROM agg GROUP BY device, tick), {fuzzy_ctes('win', 'device, tick')}"""
_NAMES = list(METHODS)
SQL |= {
    "fuzzy_index": f'WITH {_WIDE_SQL} SELECT device, tick, status, round("score_A", 5) AS "score_A", round("score_V", 5) AS "score_V", round("score_M", 5) AS "score_M", round(index_value, 5) AS index_value, rules_fired FROM hf',
    "baselines": f"WITH {_WIDE_SQL}, {baseline_cte()} SELECT device, tick, round(fuzzy_max, 5) AS fuzzy_max, round(weighted_mean, 5) AS weighted_mean, round(crisp_value, 5)::DOUBLE AS crisp_value, crisp FROM bl",
    "method_agreement": f"WITH {_WIDE_SQL}, {baseline_cte()}, "
    + agreement_sql(" UNION ALL ".join(f"SELECT '{a}' AS method_a, '{b}' AS method_b, {METHODS[a]} AS a, {METHODS[b]} AS b FROM bl" for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :]), "method_a, method_b"),
    "masking": f"WITH {_WIDE_SQL}, {baseline_cte()}, l AS ({' UNION ALL '.join(f"SELECT '{m}' AS method, {c} AS s FROM bl WHERE round(fuzzy_max, 9) >= 75" for m, c in METHODS.items())}) SELECT method, count(*) AS n_events, count_if(coalesce(s, -1) < 3)::BIGINT AS n_masked, round(count_if(coalesce(s, -1) < 3) / count(*), 6) AS rate FROM l GROUP BY method",
}
_BEFORE = lambda f, m: f"{f} OVER (PARTITION BY device ORDER BY epoch_us(ts) RANGE BETWEEN {m * 60_000_000} PRECEDING AND 1 PRECEDING)"
_GUESS = [(f"locf_{m}", _BEFORE("last_value(co2)", m)) for m in LOOKBACKS] + [("mean_15", _BEFORE("avg(co2)", 15))]
SQL["missing_data_strategies"] = f"""WITH {S30}, x AS (SELECT co2, {', '.join(f'{w} AS {n}' for n, w in _GUESS)} FROM readings30 WHERE lower(status) = 'ok'),
l AS ({' UNION ALL '.join(f"SELECT '{n}' AS strategy, co2, {n} AS g FROM x" for n, _ in _GUESS)})
SELECT strategy, count(*) AS n, round(count(g) / count(*), 6) AS coverage, round(avg(abs(g - co2)), 6) AS mae, round(sqrt(avg((g - co2) * (g - co2))), 6) AS rmse, count_if(round(g, 6) < round(co2, 6))::BIGINT AS n_under, count_if(round(g, 6) > round(co2, 6))::BIGINT AS n_over FROM l GROUP BY strategy"""
