"""Hard and soft quality checks on long slot tables: device, tick (optional), channel, slot, value, ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHANNELS, STATUS, QualityConfig

SLOTS = ["device", "tick", "channel"]


def numeric(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def pm_ordered(cols: list[Column], tolerance: float) -> Column:
    """Each size fraction at most the next, with slack; passes where any of them is missing or no number."""
    there, ok = F.lit(True), F.lit(True)
    for c in cols:
        there = there & numeric(c)
    for a, b in zip(cols, cols[1:], strict=False):
        ok = ok & (a <= b + F.abs(b) * tolerance)
    return F.when(there, ok).otherwise(F.lit(True))


def hard(channel: Column, value: Column, matched: Column, status: Column, pm_ok: Column) -> Column:
    """struct(state, reason) by the first rule that holds: no reading, device status, no number, range, PM order, valid."""
    forced = F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.lower(F.coalesce(status, F.lit("ok"))))
    lo = F.try_element_at(F.create_map(*[x for k, v in CHANNELS.items() for x in (F.lit(k), F.lit(v[0]))]), channel)
    hi = F.try_element_at(F.create_map(*[x for k, v in CHANNELS.items() for x in (F.lit(k), F.lit(v[1]))]), channel)
    is_ = lambda state, reason: F.struct(F.lit(state).alias("state"), F.lit(reason).cast("string").alias("reason"))
    return (
        F.when(~matched, is_("MISSING", "data_loss"))
        .when(forced == "MISSING", is_("MISSING", "data_loss"))
        .when(forced == "INVALID", is_("INVALID", "out_of_range"))
        .when(~numeric(value), is_("INVALID", "out_of_range"))
        .when(~value.between(lo, hi), is_("INVALID", "out_of_range"))
        .when(channel.isin("pm2_5", "pm10") & ~pm_ok, is_("INVALID", "out_of_range"))
        .otherwise(is_("VALID", None))
    )


def to_long(wide: DataFrame, keys: list[str], channels: list[str], keep: list[str]) -> DataFrame:
    """One row per channel: keys, kept columns, channel, value."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in channels)
    return wide.selectExpr(*keys, *keep, f"stack({len(channels)}, {pairs}) as (channel, value)")


def with_hampel(df: DataFrame, keys: list[str], order: str, value: str, window: int = 11, k: float = 3.0) -> DataFrame:
    """hampel_median, hampel_mad, is_outlier by the causal window of `window` rows, all of which must hold a value.

    The deviations are taken about the window's own median, so the window is an array, not two running percentiles.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    out = df.withColumn("_w", F.array_sort(F.collect_list(value).over(w)))
    half = window // 2
    mid = (lambda a: F.get(a, F.lit(half))) if window % 2 else (lambda a: (F.get(a, F.lit(half - 1)) + F.get(a, F.lit(half))) / 2)
    full = (F.size("_w") == window) & F.col(value).isNotNull()
    out = out.withColumn("hampel_median", F.when(full, mid(F.col("_w"))))
    out = out.withColumn("hampel_mad", F.when(full, mid(F.array_sort(F.transform("_w", lambda y: F.abs(y - F.col("hampel_median"))))) * 1.4826))
    far = F.when(F.col("hampel_mad") > 0, F.abs(F.col(value) - F.col("hampel_median")) > k * F.col("hampel_mad")).otherwise(F.col(value) != F.col("hampel_median"))
    return out.withColumn("is_outlier", F.coalesce(full & far, F.lit(False))).drop("_w")


def with_stuck(df: DataFrame, keys: list[str], order: str, value: str, repeats: int = 5) -> DataFrame:
    """is_stuck: in a run of at least `repeats` equal values (the whole run, looking back from its end)."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumn("_new", F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w))
    run = Window.partitionBy(*keys, "_g")
    return out.withColumn("is_stuck", (F.count(F.lit(1)).over(run) >= repeats) & F.col(value).isNotNull()).drop("_new", "_g")


def with_drift(df: DataFrame, keys: list[str], order: str, value: str, steps: int, least: Column) -> DataFrame:
    """is_drift: the latest of at least `steps` steps in one direction that sum to at least `least`; nulls and ties start anew."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = F.signum(F.col(value) - F.lag(value).over(w))
    out = df.withColumns({"_prev": F.lag(value).over(w), "_s": d})
    new = F.col("_s").isNull() | (F.col("_s") == 0) | ~F.col("_s").eqNullSafe(F.lag("_s").over(w))
    out = out.withColumn("_g", F.sum(F.when(new, 1).otherwise(0)).over(w))
    run = Window.partitionBy(*keys, "_g").orderBy(order)
    n, begin = F.row_number().over(run), F.first("_prev").over(run)
    flag = F.col("_s").isNotNull() & (F.col("_s") != 0) & (n >= steps) & (F.abs(F.col(value) - begin) >= least)
    flag0 = (F.col("_s") == 0) & (F.lit(1) >= steps) & (F.abs(F.col(value) - F.col("_prev")) >= least)
    return out.withColumn("is_drift", F.coalesce(flag | flag0, F.lit(False))).drop("_prev", "_s", "_g")


def with_persistence(df: DataFrame, keys: list[str], order: str, flag: str, least: int = 2, strict: bool = False) -> DataFrame:
    """persists: the flag's run is at least `least` long. Points without the flag belong to the run before them, as in the
    method's own rule; `strict` counts flagged points alone."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.coalesce(F.lag(flag).over(w), F.lit(False))
    joins = (F.col(flag) & before) | ~F.col(flag) if not strict else F.col(flag).eqNullSafe(before)
    out = df.withColumn("_g", F.sum(F.when(joins, 0).otherwise(1)).over(w))
    run = Window.partitionBy(*keys, "_g")
    return out.withColumn("persists", F.col(flag) & (F.count(F.lit(1)).over(run) >= least)).drop("_g")


def with_hampel_flags(df: DataFrame, key: str, order: str, values: dict[str, Column], cadence_s: int, window: int = 11, k: float = 3.0) -> DataFrame:
    """is_outlier_<name> for each of `values`, by the causal window of `window` slots of `cadence_s` that must all hold one.

    `df` has a row a slot (timestamp column `order`), absent slots have none. A key's series is cut by the hour, each part
    with a halo of the window's length, so that a long series is many tasks; all values share one exchange and one frame.
    """
    reach = (window - 1) * cadence_s
    s = F.unix_seconds(F.col(order).cast("timestamp"))
    hour = F.floor(s / 3600)
    x = df.withColumns({"_s": s, "_own": hour, **{f"_v_{n}": v for n, v in values.items()}})
    x = x.withColumn("_part", F.explode(F.array_distinct(F.array(hour, F.floor((s + reach) / 3600)))))
    w = Window.partitionBy(key, "_part").orderBy("_s").rangeBetween(-reach, 0)
    x = x.withColumns({f"_w_{n}": F.array_sort(F.collect_list(f"_v_{n}").over(w)) for n in values}).where(F.col("_part") == F.col("_own"))
    mid = lambda a: F.get(a, F.lit(window // 2))
    out = {}
    distances = lambda a, m: F.transform(a, lambda y: F.abs(y - m))
    for n in values:
        far = F.abs(F.col(f"_v_{n}") - F.col(f"_m_{n}"))
        spread = mid(F.array_sort(distances(F.col(f"_w_{n}"), F.col(f"_m_{n}")))) * 1.4826
        full = (F.size(f"_w_{n}") == window) & F.col(f"_v_{n}").isNotNull()
        out[f"is_outlier_{n}"] = F.coalesce(F.when(full, F.when(spread > 0, far > k * spread).otherwise(far > 0)), F.lit(False))
    x = x.withColumns({f"_m_{n}": mid(F.col(f"_w_{n}")) for n in values}).withColumns(out)
    return x.drop("_s", "_own", "_part", *[f"_{p}_{n}" for n in values for p in "vwm"])


def soft(df: DataFrame, keys: list[str], order: str, cfg: QualityConfig | None = None) -> DataFrame:
    """stage2, usable, confirmed, reasons for rows (keys, order, channel, value, state, reason, aux: array, secondary, trend).

    Candidates are outliers, stuck values and drifts among valid values. PM is confirmed by an auxiliary channel moving the
    same way or the outdoor trend, temperature and humidity by the second sensor or the trend, CO2 by persistence alone;
    persistence is always needed. A column `is_outlier` that is there already is taken as it is.
    """
    cfg = cfg or QualityConfig()
    w = Window.partitionBy(*keys).orderBy(order)
    least = F.try_element_at(F.create_map(*[x for c, v in CHANNELS.items() for x in (F.lit(c), F.lit(cfg.drift_factor * v[2]))]), F.col("channel"))
    near = F.try_element_at(F.create_map(F.lit("temperature"), F.lit(1.3), F.lit("humidity"), F.lit(9.0)), F.col("channel"))
    x = df.withColumn("x", F.when(F.col("state") == "VALID", F.col("value")))
    if "is_outlier" not in df.columns:
        x = with_hampel(x, keys, order, "x", cfg.hampel_window, cfg.hampel_k)
    x = with_stuck(x, keys, order, "x", cfg.stuck_repeats)
    x = with_drift(x, keys, order, "x", cfg.drift_steps, least)
    x = x.withColumn("suspect", F.col("is_outlier") | F.col("is_stuck") | F.col("is_drift"))
    x = with_persistence(x, keys, order, "suspect", cfg.persist)
    step = F.signum(F.col("x") - F.lag("x").over(w))
    x = x.withColumn("_step", step).withColumn("_aux", F.lag("aux").over(w))
    moves = F.exists(F.arrays_zip(F.col("aux").alias("a"), F.col("_aux").alias("b")), lambda p: F.coalesce((F.signum(p["a"] - p["b"]) == F.col("_step")) & (F.col("_step") != 0), F.lit(False)))
    whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    trend = F.coalesce((F.col("trend") != 0) & (F.signum(F.col("x") - F.first("x", ignorenulls=True).over(whole)) == F.col("trend")), F.lit(False))
    second = F.coalesce(F.abs(F.col("x") - F.col("secondary")) <= near, F.lit(False))
    backed = F.when(F.col("channel").isin("pm2_5", "pm10"), F.coalesce(moves, F.lit(False)) | trend).when(F.col("channel").isin("temperature", "humidity"), second | trend).otherwise(True)
    x = x.withColumn("_ok", F.col("persists") & backed)
    valid = F.col("state") == "VALID"
    reasons = F.array_compact(F.array(F.when(F.col("is_stuck"), F.lit("stuck_value")), F.when(F.col("is_drift"), F.lit("gradual_drift")), F.when(F.col("is_outlier") & ~F.col("is_stuck"), F.lit("single_spike"))))
    return x.withColumns(
        {
            "stage2": F.when(~valid, F.col("state")).when(F.col("suspect"), "SUSPECT").otherwise("VALID"),
            "usable": valid & (~F.col("suspect") | F.col("_ok")),
            "confirmed": F.when(valid & F.col("suspect"), F.col("_ok")),
            "reasons": F.when(~valid, F.array_compact(F.array("reason"))).otherwise(F.when(F.col("suspect"), reasons).otherwise(F.array().cast("array<string>"))),
        }
    ).drop("_step", "_aux", "_ok")


def time_weighted(df: DataFrame, keys: list[str], order: str, value: str, usable: Column, start: Column, end: Column, least: float) -> DataFrame:
    """keys, n_expected, n_usable, coverage, ok, mean: midpoint-rule mean of the usable points, edges clipped to the window."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    good = usable & F.col(value).isNotNull()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_expected"), F.count_if(usable).alias("n_usable"))
    w = Window.partitionBy(*keys).orderBy(order)
    p = df.where(good).withColumns({"_t": us(F.col(order)), "_a": us(start), "_b": us(end)})
    p = p.withColumns({"_p": F.lag("_t").over(w), "_n": F.lead("_t").over(w)})
    left, right = F.coalesce((F.col("_p") + F.col("_t")) / 2, F.col("_a")), F.coalesce((F.col("_t") + F.col("_n")) / 2, F.col("_b"))
    p = p.withColumn("_d", F.greatest(right - left, F.lit(0.0)))
    sums = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), F.first(value).alias("_one"), F.sum(F.col("_d") * F.col(value)).alias("_m"), F.sum("_d").alias("_w"))
    got = counts.join(sums, keys, "left").withColumn("coverage", F.col("n_usable") / F.col("n_expected")).withColumn("ok", F.col("coverage") >= least)
    mean = F.when(F.col("_k") == 1, F.col("_one")).when(F.col("_w") > 0, F.try_divide("_m", "_w"))
    return got.withColumn("mean", F.when(F.col("ok"), mean)).drop("_k", "_one", "_m", "_w")


def completeness(agg: DataFrame, keys: list[str]) -> DataFrame:
    """status, missing_components, missing_inputs per window from per-channel `ok`: 0, 1, more missing components."""
    bad = agg.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("channel")))).alias("missing_inputs"), F.collect_set(F.when(F.col("ok"), F.col("channel"))).alias("_good"))
    need = {"A": ("pm2_5", "pm10"), "M": ("temperature", "humidity"), "V": ("co2",)}
    gone = F.array_compact(F.array(*[F.when(F.size(F.array_intersect("_good", F.array(*[F.lit(c) for c in m]))) < len(m), F.lit(k)) for k, m in need.items()]))
    out = bad.withColumn("missing_components", gone).drop("_good")
    n = F.size("missing_components")
    return out.withColumn("status", F.when(n == 0, "OK").when(n == 1, "PARTIAL").otherwise("FAILED"))
