"""Hourly tables: invalid-value rules, distributions, rolling features, forecast targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import INDICATORS
from ..functions.scores import season
from .sequence import regular_grid

HOUR = 3600
WINDOWS = (3, 6, 24)


def invalid_rules() -> dict[str, tuple[str, Column]]:
    c = F.col
    return {  # fixed values
        "co2_below_min": ("co2", c("co2") < 350),
        "co2_error_code": ("co2", c("co2") == 9999),
        "pm25_above_max": ("pm25", c("pm25") > 1000),
        "pm10_above_max": ("pm10", c("pm10") > 1000),
        "t_out_of_range": ("t", ~c("t").between(5, 40)),
        "rh_out_of_range": ("rh", ~c("rh").between(5, 95)),
    }


def without_invalid(df: DataFrame) -> DataFrame:
    """Values that break a rule become null; all rules read the original values."""
    out = {}
    for i in INDICATORS:
        bad = [m for who, m in invalid_rules().values() if who == i]
        out[i] = F.when(~F.coalesce(reduce(lambda a, b: a | b, bad), F.lit(False)), F.col(i))
    return df.withColumns(out)


def invalid_counts(df: DataFrame) -> DataFrame:
    """rule, indicator, n_removed, n_present: one pass."""
    rules = invalid_rules()
    one = df.agg(*[F.count_if(m).alias(f"n_{r}") for r, (_, m) in rules.items()], *[F.count(i).alias(f"p_{i}") for i in INDICATORS])
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("indicator"), F.col(f"n_{r}").alias("n_removed"), F.col(f"p_{i}").alias("n_present")) for r, (i, _) in rules.items()])
    return one.select(F.inline(rows))


def grid(readings: DataFrame) -> DataFrame:
    """Cleaned hourly grid with season and observed; absent hours are null rows, never filled."""
    return regular_grid(without_invalid(readings), "home", "time").withColumn("season", season(F.col("time")))


def seconds(t: str) -> Column:
    return F.unix_seconds(F.col(t).cast("timestamp"))


def hours_back(key: str, time: str, hours: int):
    return Window.partitionBy(key).orderBy(seconds(time)).rangeBetween(-(hours * HOUR - 1), 0)


#: A home's series is cut into parts of so many hours for rolling frames.
PART_HOURS = 720


def cut(df: DataFrame, time: str, halo_hours: int) -> DataFrame:
    """`df` with `_part` (PART_HOURS of time) and `_own`: a row also stands in the next part where its last `halo_hours` reach
    into it (`_own` false there), so that every trailing frame is whole within a part and a long series is many tasks."""
    h = F.floor(seconds(time) / HOUR)
    part, reach = F.floor(h / PART_HOURS), F.floor((h + halo_hours) / PART_HOURS)
    return df.withColumn("_own", part).withColumn("_part", F.explode(F.array_distinct(F.array(part, reach)))).withColumn("_own", F.col("_own") == F.col("_part"))


def rolling(df: DataFrame, indicators: tuple[str, ...] = INDICATORS, windows: tuple[int, ...] = WINDOWS, coverage: float = 0.8) -> DataFrame:
    """<x>_<mean|min|max|std>_<w>h over (t - w, t], diff1_<x>, calendar columns, and `eligible`: every window of every indicator
    covered, every difference and the index present. All frames share one exchange and sort, by home and part."""
    cols: dict[str, Column] = {}
    ok = F.col("I").isNotNull()
    by = Window.partitionBy("home", "_part").orderBy(seconds("time"))
    for x in indicators:
        for w in windows:
            frame = by.rangeBetween(-(w * HOUR - 1), 0)
            for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_samp)):
                cols[f"{x}_{name}_{w}h"] = f(x).over(frame)
            ok = ok & (F.count(x).over(frame) / w >= coverage)
        cols[f"diff1_{x}"] = F.col(x) - F.lag(x).over(by)
        ok = ok & (F.col(x) - F.lag(x).over(by)).isNotNull()
    cols["hour_sin"], cols["hour_cos"] = F.sin(2 * F.pi() * F.hour("time") / 24), F.cos(2 * F.pi() * F.hour("time") / 24)
    cols["weekend"] = F.when(F.weekday("time") >= 5, 1).otherwise(0)
    cols["season_heating"] = F.when(F.col("season") == "heating", 1).otherwise(0)
    return cut(df, "time", max(windows)).withColumns({**cols, "eligible": ok}).where("_own").drop("_own", "_part")


def targets(df: DataFrame, cols: list[str], horizons: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """<c>__h<h>: value h hours on; <c>__h<h>_lag24: value at the same hour a day before that. The grid has no gaps."""
    w = Window.partitionBy("home").orderBy("time")
    out = {}
    for h in horizons:
        for c in cols:
            out[f"{c}__h{h}"] = F.lead(c, h).over(w)
            out[f"{c}__h{h}_lag24"] = F.lag(c, 24 - h).over(w)
    return df.withColumns(out)


def time_split(df: DataFrame, share: float = 0.75, gap_hours: int = 30) -> DataFrame:
    """part: train up to `share` of each home's span, nothing for `gap_hours`, then test."""
    w = Window.partitionBy("home")
    s = seconds("time")
    cut = F.min(s).over(w) + F.floor((F.max(s).over(w) - F.min(s).over(w)) * share)
    return df.withColumn("part", F.when(s <= cut, "train").when(s > cut + gap_hours * HOUR, "test"))
