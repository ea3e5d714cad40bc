"""The two-level worst-of fuzzy index in closed form.

A worst-of rule base over inputs with degrees m_k(class) activates severity s by
max over j of min(m_j(s), min over k != j of max over t <= s of m_k(t)), so no rule is ever listed and an absent input drops
out. The centroid is taken over an even universe of 0 to 100.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLASSES4, FuzzyConfig

_INF = float("inf")
Degrees = list[Column]


def trapezoid(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """Rises from a to b, falls from c to d; an infinite or equal pair is a shoulder."""
    up = F.lit(1.0) if b == -_INF else (x - a) / (b - a) if b > a else F.when(x >= a, 1.0).otherwise(0.0)
    down = F.lit(1.0) if c == _INF else (d - x) / (d - c) if d > c else F.when(x <= d, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(up, F.lit(1.0), down))


def monotonic_shapes(b: tuple[float, float, float], w: float) -> list[list[tuple]]:
    h = w / 2
    edges = [(x - h, x + h) for x in b]
    return [[(-_INF, -_INF, *edges[0])], [(*edges[0], *edges[1])], [(*edges[1], *edges[2])], [(*edges[2], _INF, _INF)]]


def two_sided_shapes(e: tuple[float, ...], w: float) -> list[list[tuple]]:
    h = w / 2
    band = lambda lo, hi: (lo - h, lo + h, hi - h, hi + h)
    return [[band(e[2], e[3])], [band(e[1], e[2]), band(e[3], e[4])], [band(e[0], e[1]), band(e[4], e[5])], [(-_INF, -_INF, e[0] - h, e[0] + h), (e[5] - h, e[5] + h, _INF, _INF)]]


def memberships(x: Column, shapes: list[list[tuple]]) -> Degrees:
    """Degree in each of the four classes, null for null."""
    out = []
    for shape in shapes:
        parts = [trapezoid(x, *s) for s in shape]
        out.append(F.when(x.isNotNull(), F.greatest(*parts) if len(parts) > 1 else parts[0]))
    return out


def _worst(*cols: Column) -> Column:
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def _least(*cols: Column) -> Column:
    return cols[0] if len(cols) == 1 else F.least(*cols)


def activation(inputs: list[Degrees]) -> Degrees:
    """Worst-of activation of each severity; inputs that are null drop out (least and greatest skip nulls)."""
    upto = [[_worst(*m[: s + 1]) for s in range(4)] for m in inputs]
    out = []
    for s in range(4):
        terms = []
        for j, m in enumerate(inputs):
            others = [upto[k][s] for k in range(len(inputs)) if k != j]
            terms.append(F.when(m[s].isNotNull(), _least(m[s], *others)))
        out.append(_worst(*terms))
    return out


def output_curves(cfg: FuzzyConfig) -> list[list[float]]:
    """Membership of each universe point in each output class."""

    def at(u: float, s: tuple) -> float:
        a, b, c, d = s
        up = 1.0 if b == -_INF else (u - a) / (b - a)
        down = 1.0 if c == _INF else (d - u) / (d - c)
        return max(0.0, min(up, 1.0, down))

    shapes = monotonic_shapes(*cfg.output)
    n = cfg.points - 1
    return [[max(at(100.0 * i / n, s) for s in shape) for i in range(cfg.points)] for shape in shapes]


def centroid(act: Degrees, cfg: FuzzyConfig | None = None) -> Column:
    """Centre of the clipped, joined output sets; null where nothing is active. Array functions only: it stays in the JVM.

    Clipped curves overlap only in the transition bands, so each class's weight and moment split into a flat part and two
    ramps; rather than that algebra, the universe is walked once per row.
    """
    cfg = cfg or FuzzyConfig()
    n = cfg.points - 1
    points = F.array(*[F.struct(F.lit(100.0 * i / n).alias("u"), *[F.lit(c[i]).alias(f"c{k}") for k, c in enumerate(output_curves(cfg))]) for i in range(cfg.points)])
    a = [F.coalesce(x, F.lit(0.0)) for x in act]
    mu = lambda p: F.greatest(*[F.least(p[f"c{k}"], a[k]) for k in range(4)])
    zero = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("w"))
    step = lambda s, p: F.struct((s["m"] + p["u"] * mu(p)).alias("m"), (s["w"] + mu(p)).alias("w"))
    done = lambda s: F.when(s["w"] > 0, s["m"] / s["w"])
    return F.when(F.greatest(*a) > 0, F.aggregate(points, zero, step, done))


def with_centroid(df: DataFrame, degrees: list[str], name: str, cfg: FuzzyConfig | None = None) -> DataFrame:
    """Adds `name`: the centroid of the four degree columns, vectorised (Arrow, a chunk of rows against the universe)."""
    cfg = cfg or FuzzyConfig()
    curves, u = np.array(output_curves(cfg)), np.linspace(0.0, 100.0, cfg.points)

    def centre(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        act = np.nan_to_num(np.stack([a, b, c, d], axis=1).astype(float))
        out = np.empty(len(act))
        for i in range(0, len(act), 4096):
            mu = np.minimum(act[i : i + 4096, 0, None], curves[0])
            for k in range(1, 4):
                np.maximum(mu, np.minimum(act[i : i + 4096, k, None], curves[k]), out=mu)
            w = mu.sum(axis=1)
            with np.errstate(invalid="ignore"):
                out[i : i + 4096] = np.where(w > 0, mu @ u / w, np.nan)
        return pd.Series(out)

    udf = F.pandas_udf(centre, "double")
    got = udf(*[F.col(c) for c in degrees])
    return df.withColumn(name, F.when(~F.isnan(got), got))


def infer(df: DataFrame, cfg: FuzzyConfig | None = None, tie: float = 1.0) -> DataFrame:
    """From pm2_5, pm10, co2, temperature, humidity (null: absent) to component degrees and scores, the index, its class,
    completeness, the number of rules that fire, and dominance (step by step on at most 64 implied rules).

    A component needs all its inputs. No component or one missing gives OK or PARTIAL; two or more FAILED and a null index.
    """
    cfg = cfg or FuzzyConfig()
    has = {"A": F.col("pm2_5").isNotNull() & F.col("pm10").isNotNull(), "V": F.col("co2").isNotNull(), "M": F.col("temperature").isNotNull() & F.col("humidity").isNotNull()}
    a = activation([memberships(F.col("pm2_5"), monotonic_shapes(*cfg.pm2_5)), memberships(F.col("pm10"), monotonic_shapes(*cfg.pm10))])
    v = memberships(F.col("co2"), monotonic_shapes(*cfg.co2))
    m = activation([memberships(F.col("temperature"), two_sided_shapes(*cfg.temperature)), memberships(F.col("humidity"), two_sided_shapes(*cfg.humidity))])
    cols = {}
    for name, d in (("A", a), ("V", v), ("M", m)):
        for s in range(4):
            cols[f"{name}{s}"] = F.when(has[name], d[s])
    out = df.withColumns(cols)
    for name in "AVM":
        out = with_centroid(out, [f"{name}{s}" for s in range(4)], f"score_{name}", cfg)
        out = out.withColumn(f"score_{name}", F.when(F.col(f"{name}0").isNotNull(), F.coalesce(f"score_{name}", F.lit(0.0))))
    missing = F.array_compact(F.array(*[F.when(~has[n], F.lit(n)) for n in ("A", "M", "V")]))
    out = out.withColumn("missing", missing).withColumn("status", F.when(F.size("missing") == 0, "OK").when(F.size("missing") == 1, "PARTIAL").otherwise("FAILED"))
    act = activation([[F.col(f"{n}{s}") for s in range(4)] for n in "AVM"])
    out = out.withColumns({f"out{s}": act[s] for s in range(4)})
    out = with_centroid(out, [f"out{s}" for s in range(4)], "index_value", cfg)
    out = out.withColumn("index_value", F.when(F.col("status") != "FAILED", F.col("index_value")))
    fires = [F.when(F.col(f"{n}0").isNotNull(), sum((F.when(F.col(f"{n}{s}") > 0, 1).otherwise(0) for s in range(4)), F.lit(0))) for n in "AVM"]
    out = out.withColumn("rules_fired", F.coalesce(fires[0], F.lit(1)) * F.coalesce(fires[1], F.lit(1)) * F.coalesce(fires[2], F.lit(1)))
    from .scores import output_class

    return dominant(out.withColumn("index_class", output_class(F.round("index_value", 9))), tie)


def dominant(df: DataFrame, tie: float = 1.0) -> DataFrame:
    """dominant, co_dominant: of the rules with the greatest firing strength and, among them, the worst consequent, the inputs
    that hold the rule down, at their worst class; ties within `tie` points of score stay, by name.

    With M_k the largest degree of component k, the greatest strength is min M_k. A component binds a top rule exactly where
    its own degree in that rule equals the strength; its worst such class follows from its degrees alone, within the worst
    consequent S that any component can reach at that strength.
    """
    eps = 1e-9
    names = ["A", "M", "V"]
    there = {n: F.col(f"{n}0").isNotNull() for n in names}
    most = {n: F.when(there[n], F.greatest(*[F.col(f"{n}{s}") for s in range(4)])) for n in names}
    out = df.withColumn("_top", F.least(*[most[n] for n in names]))
    reach = {n: F.when(there[n], F.greatest(*[F.when(F.col(f"{n}{s}") >= F.col("_top") - eps, s) for s in range(4)])) for n in names}
    out = out.withColumn("_sev", F.greatest(*[reach[n] for n in names]))
    # worst class of n in a top rule with consequent _sev in which n attains the rule's minimum
    worst = {}
    for n in names:
        others = [k for k in names if k != n]
        options = []
        for s in range(4):
            d = F.col(f"{n}{s}")
            # others can complete the rule at no less than d, and the consequent is reached by n or by one of them
            can = F.lit(True)
            reach_any = F.lit(s) == F.col("_sev")
            for k in others:
                can = can & (~there[k] | (F.coalesce(most[k], F.lit(0.0)) >= d))
                at = F.when(F.col("_sev") == 0, F.col(f"{k}0")).when(F.col("_sev") == 1, F.col(f"{k}1")).when(F.col("_sev") == 2, F.col(f"{k}2")).otherwise(F.col(f"{k}3"))
                reach_any = reach_any | F.coalesce(at >= d, F.lit(False))
            options.append(F.when(there[n] & (d > 0) & (F.abs(d - F.col("_top")) <= eps) & (F.lit(s) <= F.col("_sev")) & can & reach_any, s))
        worst[n] = F.greatest(*options)
    out = out.withColumns({f"_w{n}": worst[n] for n in names})
    out = out.withColumn("_wmax", F.greatest(*[F.col(f"_w{n}") for n in names]))
    final = {n: (F.col(f"_w{n}") == F.col("_wmax")) & (F.col("_top") > 0) for n in names}
    out = out.withColumn("_smax", F.greatest(*[F.when(final[n], F.col(f"score_{n}")) for n in names]))
    kept = [F.when(final[n] & (F.col("_smax") - F.col(f"score_{n}") <= tie), F.lit(n)) for n in names]
    out = out.withColumn("co_dominant", F.array_compact(F.array(*kept)))
    out = out.withColumn("dominant", F.get("co_dominant", F.lit(0)))
    return out.drop("_top", "_sev", "_wmax", "_smax", *[f"_w{n}" for n in names])


def class_name(severity: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in CLASSES4]), severity)
