"""Ordered-series operators: grids, slots, as-of and last-value joins, islands, gaps, transitions.

Everything is partitioned by a series key; a series too long for one task is cut by day or by window first (`key` may be
several columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Key = str | list[str]


def _keys(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def micros(ts: Column) -> Column:
    """Whole microseconds of a timestamp (with or without zone)."""
    return F.unix_micros(ts.cast("timestamp"))


def regular_grid(df: DataFrame, key: Key, time: str, step: str = "1 hour") -> DataFrame:
    """Rows of `df` on the regular grid from each key's first to last time; absent times get null rows and observed = false.

    One aggregate per key, an explode, one join on (key, time). A time that repeats in a key raises.
    """
    keys = _keys(key)
    ends = df.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    grid = ends.select(*keys, F.explode(F.sequence("_a", "_b", F.expr(f"interval {step}"))).alias(time))
    once = Window.partitionBy(*keys, time)
    checked = df.withColumn("_n", F.count(F.lit(1)).over(once)).withColumn("observed", F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("duplicate time in a series")).cast("boolean"))).drop("_n")
    return grid.join(checked, [*keys, time], "left").withColumn("observed", F.coalesce("observed", F.lit(False)))


def asof(left: DataFrame, right: DataFrame, key: Key, left_time: str, right_time: str, value: list[str], strict: bool = False, prefix: str = "", within_us: int | None = None) -> DataFrame:
    """Backward as-of join: the latest right row at or before (`strict`: before) each left row, nulls where there is none.

    Both sides are laid into one series and the last right row is carried on: one exchange on the key, no theta join.
    `within_us` bounds the age. Right rows of one time: the greatest values win.
    """
    keys = _keys(key)
    payload = F.struct(F.col(right_time).alias("_rt"), *[F.col(v).alias(f"_v{i}") for i, v in enumerate(value)])
    r = right.select(*keys, F.col(right_time).alias("_t"), payload.alias("_r"), F.lit(0 if not strict else 1).alias("_side"))
    lrow = left.select(*keys, F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(1 if not strict else 0).alias("_side"))
    both = r.unionByName(lrow, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where(F.col("_l").isNotNull())
    ok = F.col("_last").isNotNull()
    if within_us is not None:
        ok = ok & (micros(F.col("_t")) - micros(F.col("_last._rt")) <= within_us)
    cols = [F.when(ok, F.col("_last._rt")).alias(f"{prefix}{right_time}")] + [F.when(ok, F.col(f"_last._v{i}")).alias(f"{prefix}{v}") for i, v in enumerate(value)]
    return got.select(*[F.col(f"_l.`{c}`").alias(c) for c in left.columns], *cols)


def locf(df: DataFrame, key: Key, time: str, value: str, lookback_us: int, valid: Column, name: str) -> DataFrame:
    """Last valid value strictly before each row, at most `lookback_us` old, with its time: a range frame, no join."""
    w = Window.partitionBy(*_keys(key)).orderBy(micros(F.col(time))).rangeBetween(-lookback_us, -1)
    got = F.last(F.when(valid, F.struct(F.col(time).alias("t"), F.col(value).alias("v"))), ignorenulls=True).over(w)
    return df.withColumn("_x", got).withColumns({name: F.col("_x.v"), f"{name}_time": F.col("_x.t")}).drop("_x")


def slot_match(df: DataFrame, key: Key, time: str, cadence_s: int = 30, tolerance_s: int = 15) -> DataFrame:
    """Each reading at its nearest slot of a fixed grid, one reading a slot and one slot a reading: adds slot, offset_us.

    Needs tolerance <= cadence / 2: then a reading has two candidate slots only exactly between them; it is offered to both
    and keeps the nearer, then the earlier. A reading left without a slot is dropped.
    """
    if 2 * tolerance_s > cadence_s:
        raise ValueError("tolerance must be at most half the cadence")
    keys, step = _keys(key), cadence_s * 1_000_000
    us = micros(F.col(time))
    low = F.floor(us / step) * step
    near = F.when(us - low <= tolerance_s * 1_000_000, low)
    far = F.when(low + step - us <= tolerance_s * 1_000_000, low + step)
    cand = df.withColumn("_slot", F.explode(F.array_compact(F.array(near, far)))).withColumn("offset_us", us - F.col("_slot"))
    by_slot = Window.partitionBy(*keys, "_slot").orderBy(F.abs("offset_us"), time)
    cand = cand.withColumn("_r", F.row_number().over(by_slot)).where("_r = 1").drop("_r")
    by_reading = Window.partitionBy(*keys, time).orderBy(F.abs("offset_us"), "_slot")
    cand = cand.withColumn("_r", F.row_number().over(by_reading)).where("_r = 1").drop("_r")
    return cand.withColumn("slot", F.timestamp_micros("_slot").cast("timestamp_ntz")).drop("_slot")


def ticks(df: DataFrame, key: Key, time: str, every_min: int) -> DataFrame:
    """Aligned recompute instants in (first, last] of each key."""
    keys, step = _keys(key), every_min * 60
    s = F.unix_micros(F.col(time).cast("timestamp"))
    ends = df.groupBy(*keys).agg(F.floor(F.min(s) / (step * 1_000_000)).alias("_a"), F.floor(F.max(s) / (step * 1_000_000)).alias("_b"))
    ends = ends.where("_b > _a").select(*keys, F.explode(F.sequence(F.col("_a") + 1, F.col("_b"))).alias("_k"))
    return ends.select(*keys, F.timestamp_micros(F.col("_k") * step * 1_000_000).cast("timestamp_ntz").alias("tick"))


def islands(df: DataFrame, key: Key, order: str, breaks: Column, name: str = "island") -> DataFrame:
    """Adds a run number that grows wherever `breaks` holds (nulls do not break)."""
    w = Window.partitionBy(*_keys(key)).orderBy(order)
    return df.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(w))


def changed(value: Column, key: Key, order: str) -> Column:
    """Whether a value differs from the one before it in its series (null counts as a value)."""
    w = Window.partitionBy(*_keys(key)).orderBy(order)
    return ~value.eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)


def runs(df: DataFrame, key: Key, order: str, flag: Column, extra: list[Column] | None = None, min_len: int = 1) -> DataFrame:
    """Contiguous stretches where `flag` is true: start, end, n of each, at least `min_len` long."""
    keys = _keys(key)
    marked = islands(df.withColumn("_f", F.coalesce(flag, F.lit(False))), key, order, changed(F.col("_f"), key, order), "_g")
    return marked.where("_f").groupBy(*keys, "_g").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("n"), *(extra or [])).where(F.col("n") >= min_len).drop("_g")


def gaps(df: DataFrame, key: Key, time: str, longer_us: int) -> DataFrame:
    """Neighbouring times further apart than `longer_us`: gap_start, gap_end, gap_s."""
    w = Window.partitionBy(*_keys(key)).orderBy(time)
    return df.withColumn("gap_start", F.lag(time).over(w)).withColumn("_d", micros(F.col(time)) - micros(F.col("gap_start"))).where(F.col("_d") > longer_us).select(*_keys(key), "gap_start", F.col(time).alias("gap_end"), (F.col("_d") / 1e6).alias("gap_s"))


def transitions(df: DataFrame, key: Key, time: str, rank: str, gap_us: int) -> DataFrame:
    """kind of each step between neighbours: none, adjacent, nonadjacent, or gap_excluded; reversal marks A-B-A."""
    w = Window.partitionBy(*_keys(key)).orderBy(time)
    one, two = F.lag(rank).over(w), F.lag(rank, 2).over(w)
    age, age2 = micros(F.col(time)) - micros(F.lag(time).over(w)), micros(F.lag(time).over(w)) - micros(F.lag(time, 2).over(w))
    step = F.abs(F.col(rank) - one)
    kind = F.when(age > gap_us, "gap_excluded").when(step == 0, "none").when(step == 1, "adjacent").otherwise("nonadjacent")
    aba = (F.col(rank) == two) & (F.col(rank) != one) & (age <= gap_us) & (age2 <= gap_us)
    return df.withColumns({"kind": F.when(one.isNotNull() & F.col(rank).isNotNull(), kind), "reversal": F.coalesce(aba, F.lit(False))})


def dwell(df: DataFrame, key: Key, time: str, rank: str, gap_us: int) -> DataFrame:
    """Stays in one class without a gap: start, end, n, rank of each."""
    w = Window.partitionBy(*_keys(key)).orderBy(time)
    new = changed(F.col(rank), key, time) | (micros(F.col(time)) - micros(F.lag(time).over(w)) > gap_us)
    return islands(df, key, time, new, "_g").groupBy(*_keys(key), "_g", rank).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n")).drop("_g")


def within_intervals(points: DataFrame, events: DataFrame, key: Key, time: str, start: str, end: str, bucket_us: int, how: str = "left_semi") -> DataFrame:
    """Points inside an event of their key, start <= t <= end: an equi-join on time buckets, then the exact test.

    Each event is listed in every bucket it touches, so the join never compares all points of a key with all its events.
    """
    keys = _keys(key)
    e = events.withColumn("_bucket", F.explode(F.sequence(F.floor(micros(F.col(start)) / bucket_us), F.floor(micros(F.col(end)) / bucket_us))))
    p = points.withColumn("_bucket", F.floor(micros(F.col(time)) / bucket_us))
    e = e.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bucket").alias("_eb"), *[F.col(c).alias(f"ev_{c}") for c in events.columns if c not in keys])
    on = (p["_bucket"] == e["_eb"]) & (p[time] >= e[f"ev_{start}"]) & (p[time] <= e[f"ev_{end}"])
    for k in keys:
        on = on & (p[k] == e[f"_{k}"])
    got = p.join(e, on, how).drop("_bucket")
    return got if how in ("left_semi", "left_anti") else got.drop("_eb", *[f"_{k}" for k in keys])


def overlapping(a: DataFrame, b: DataFrame, key: Key, bucket_us: int) -> DataFrame:
    """Rows of `a` (start, end) that overlap some row of `b` of their key: a.start < b.end and a.end > b.start."""
    keys = _keys(key)
    spread = lambda d: d.withColumn("_bucket", F.explode(F.sequence(F.floor(micros(F.col("start")) / bucket_us), F.floor(micros(F.col("end")) / bucket_us))))
    x = spread(a)
    y = spread(b).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bucket").alias("_eb"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    on = (x["_bucket"] == y["_eb"]) & (x["start"] < y["_e"]) & (x["end"] > y["_s"])
    for k in keys:
        on = on & (x[k] == y[f"_{k}"])
    return x.join(y, on, "left_semi").drop("_bucket").distinct()


def best_lag(df: DataFrame, key: Key, order: str, x: str, y: str, most: int = 20, least_n: int = 30) -> DataFrame:
    """lag in [-most, most] with the largest correlation of x[i] and y[i + lag] (rows by position), smallest lag on ties."""
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_i", F.row_number().over(w))
    left = rows.select(*keys, F.col("_i"), F.col(x).alias("_x"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")).withColumn("_j", F.col("_i") + F.col("lag"))
    right = rows.select(*keys, F.col("_i").alias("_j"), F.col(y).alias("_y"))
    both = left.join(right, [*keys, "_j"]).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    per = both.groupBy(*keys, "lag").agg(F.corr("_x", "_y").alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)
    return per.groupBy(*keys).agg(F.max_by(F.struct("lag", "r", "n"), F.struct(F.round("r", 9), -F.col("lag"))).alias("b")).select(*keys, F.col("b.lag").alias("lag"), F.col("b.r").alias("r"), F.col("b.n").alias("n"))
