"""Deviation scores, classes and the additive/worst-component index, as Column builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLASSES4, INDICATORS, Breakpoints, IndexConfig


def clean(x: Column) -> Column:
    """NaN and infinities as null: every source passes through this once."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def _ramp(x: Column, b: tuple[float, ...]) -> Column:
    """0 up to b[0], 25 more at each further limit, 100 from b[4]; linear between."""
    out = F.when(x <= b[0], 0.0)
    for k in range(4):
        out = out.when(x <= b[k + 1], 25.0 * k + 25.0 * (x - b[k]) / (b[k + 1] - b[k]))
    return out.when(x > b[4], 100.0)


def deviation_score(x: Column, limits: Breakpoints) -> Column:
    """0 in the normal range to 100; null for null. Two-sided indicators take the larger side."""
    high = _ramp(x, limits.high)
    return high if limits.low is None else F.greatest(high, _ramp(-x, tuple(-b for b in limits.low)))


def class_of_score(d: Column) -> Column:
    """Rank 0 to 4: 0; (0, 25]; (25, 50]; (50, 75]; (75, 100]."""
    return F.greatest(F.lit(0), F.least(F.lit(4), F.ceil(d / 25.0).cast("int"))) if d is not None else d


def class_of_value(x: Column, limits: Breakpoints) -> Column:
    """The same rank straight from the value; limits count to the better side."""

    def side(v: Column, b: tuple[float, ...]) -> Column:
        out = F.when(v <= b[0], 0)
        for k in range(1, 4):
            out = out.when(v <= b[k], k)
        return out.when(v > b[3], 4)

    high = side(x, limits.high)
    return high if limits.low is None else F.greatest(high, side(-x, tuple(-b for b in limits.low)))


def complete(cols: tuple[str, ...] = INDICATORS) -> Column:
    """All five indicators are there, so the index is: filter by this, not by the index, and the filter stays small."""
    return reduce(lambda a, b: a & b, [F.col(i).isNotNull() for i in cols])


def with_index(df: DataFrame, cfg: IndexConfig | None = None) -> DataFrame:
    """Adds d_<indicator>, Q_<component>, Q_mean, Q_max, delta, I and classes; null unless all five indicators are there."""
    cfg = cfg or IndexConfig()
    out = df.withColumns({f"d_{i}": deviation_score(F.col(i), cfg.limits[i]) for i in INDICATORS})
    whole = complete()
    parts = cfg.components
    q = {f"Q_{c}": F.when(whole, F.greatest(*[F.col(f"d_{i}") for i in m]) if len(m) > 1 else F.col(f"d_{m[0]}")) for c, m in parts.items()}
    out = out.withColumns(q)
    cols = [F.col(c) for c in q]
    out = out.withColumns({"Q_mean": reduce(lambda a, b: a + b, cols) / len(cols), "Q_max": F.when(whole, F.greatest(*cols))})
    out = out.withColumn("delta", F.greatest(F.lit(0.0), F.lit(cfg.critical) - F.col("Q_max")))
    out = out.withColumn("delta", F.when(whole, F.col("delta")))
    out = out.withColumn("I", F.when(whole, F.greatest(F.col("Q_mean"), F.col("Q_max") - F.col("delta"))))
    rank = lambda c: F.when(whole, class_of_score(F.col(c)))
    return out.withColumns({"class_I": rank("I"), **{f"class_{c}": rank(f"Q_{c}") for c in parts}})


def dominance(df: DataFrame, cfg: IndexConfig | None = None) -> DataFrame:
    """Rows with I over the threshold, dom_<component>: within tolerance of the largest component."""
    cfg = cfg or IndexConfig()
    return df.where(F.col("I") > cfg.dominance_from).withColumns({f"dom_{c}": F.col(f"Q_{c}") >= F.col("Q_max") - cfg.dominance_tolerance for c in cfg.components})


def severity(name: Column) -> Column:
    """0 to 3 for the four classes, null for others."""
    return F.when(name == CLASSES4[0], 0).when(name == CLASSES4[1], 1).when(name == CLASSES4[2], 2).when(name == CLASSES4[3], 3)


def output_class(v: Column) -> Column:
    """Below 25, 50, 75: a boundary counts to the worse class."""
    return F.when(v < 25, CLASSES4[0]).when(v < 50, CLASSES4[1]).when(v < 75, CLASSES4[2]).when(v >= 75, CLASSES4[3])


def hard_class(v: Column, b: tuple[float, float, float], worse_at_limit: bool = True) -> Column:
    """Severity by hard limits; `worse_at_limit` says to which side a limit belongs (baselines: worse; labels: better)."""
    below = (lambda x: v < x) if worse_at_limit else (lambda x: v <= x)
    return F.when(v.isNull(), None).when(below(b[0]), 0).when(below(b[1]), 1).when(below(b[2]), 2).otherwise(3)


def hard_class_two_sided(v: Column, e: tuple[float, ...]) -> Column:
    return F.when(v.isNull(), None).when(v.between(e[2], e[3]), 0).when(v.between(e[1], e[4]), 1).when(v.between(e[0], e[5]), 2).otherwise(3)


def absolute_humidity(t: Column, rh: Column) -> Column:
    """g/m3 from temperature (deg C) and relative humidity (%)."""
    return 216.7 * (6.112 * F.exp(17.62 * t / (243.12 + t)) * rh / 100.0) / (t + 273.15)


def estimation_direction(estimate: Column, truth: Column) -> Column:
    return F.when(estimate.isNull() | truth.isNull(), None).when(estimate < truth, "under").when(estimate > truth, "over").otherwise("exact")


def season(time: Column, heating: tuple[int, ...] = (10, 11, 12, 1, 2, 3, 4)) -> Column:
    return F.when(F.month(time).isin(*heating), "heating").otherwise("warm")


def most_adverse(inputs: dict[str, tuple[Column, Column]], tolerance: float = 1e-9) -> Column:
    """Names of the inputs with the worst (severity, degree): the highest severity, then the largest degree, ties kept by name."""
    rows = [F.struct(s.cast("int").alias("s"), d.alias("d"), F.lit(n).alias("n")) for n, (s, d) in sorted(inputs.items())]
    there = F.filter(F.array(*rows), lambda r: r["s"].isNotNull())
    worst = F.array_max(F.transform(there, lambda r: r["s"]))
    top = F.filter(there, lambda r: r["s"] == worst)
    most = F.array_max(F.transform(top, lambda r: r["d"]))
    return F.transform(F.filter(top, lambda r: most - r["d"] <= tolerance), lambda r: r["n"])


def has_tie(values: Column) -> Column:
    """More than one distinct entry."""
    return F.size(F.array_distinct(values)) > 1


def transition(before: Column, after: Column) -> Column:
    """none, adjacent or nonadjacent step between two ranks."""
    step = F.abs(after - before)
    return F.when(step == 0, "none").when(step == 1, "adjacent").when(step > 1, "nonadjacent")
