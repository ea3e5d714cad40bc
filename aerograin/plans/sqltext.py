"""Pieces of SQL for the oracle queries, made from the same settings as the Column builders."""

from __future__ import annotations

from ..config import INDICATORS, IndexConfig
from ..sources.adapters import HOURLY


def ramp(x: str, b: tuple[float, ...]) -> str:
    out = f"CASE WHEN {x} <= {b[0]} THEN 0.0::DOUBLE"
    for k in range(4):
        out += f" WHEN {x} <= {b[k + 1]} THEN 25.0::DOUBLE * {k} + 25.0::DOUBLE * ({x} - ({b[k]})) / ({b[k + 1] - b[k]}::DOUBLE)"
    return out + f" WHEN {x} > {b[4]} THEN 100.0::DOUBLE END"


def score(x: str, cfg: IndexConfig, name: str) -> str:
    b = cfg.limits[name]
    return ramp(x, b.high) if b.low is None else f"greatest({ramp(x, b.high)}, {ramp(f'(-{x})', tuple(-v for v in b.low))})"


CLEAN = """clean AS (SELECT home, time,
  CASE WHEN NOT coalesce(pm25 > 1000, false) THEN pm25 END AS pm25, CASE WHEN NOT coalesce(pm10 > 1000, false) THEN pm10 END AS pm10,
  CASE WHEN NOT coalesce(co2 < 350 OR co2 = 9999, false) THEN co2 END AS co2,
  CASE WHEN NOT coalesce(t < 5 OR t > 40, false) THEN t END AS t, CASE WHEN NOT coalesce(rh < 5 OR rh > 95, false) THEN rh END AS rh
  FROM readings)"""
GRID = f"""{HOURLY}, {CLEAN},
hours AS (SELECT home, unnest(generate_series(min(time), max(time), INTERVAL 1 HOUR)) AS time FROM clean GROUP BY home),
grid AS (SELECT h.home, h.time, c.home IS NOT NULL AS observed, pm25, pm10, co2, t, rh,
  CASE WHEN month(h.time) IN (10, 11, 12, 1, 2, 3, 4) THEN 'heating' ELSE 'warm' END AS season
  FROM hours h LEFT JOIN clean c ON h.home = c.home AND h.time = c.time)"""


def index(cfg: IndexConfig | None = None, name: str = "idx", source: str = "grid") -> str:
    """CTEs {name}: the grid with d_*, Q_*, Q_mean, Q_max, delta, I, class_I."""
    cfg = cfg or IndexConfig()
    d = ", ".join(f"{score(i, cfg, i)} AS d_{i}" for i in INDICATORS)
    whole = " AND ".join(f"{i} IS NOT NULL" for i in INDICATORS)
    q = ", ".join(f"CASE WHEN {whole} THEN greatest({', '.join(f'd_{i}' for i in m)}) END AS \"Q_{c}\"" for c, m in cfg.components.items())
    qs = [f'"Q_{c}"' for c in cfg.components]
    rank = lambda c: f"CASE WHEN {whole} THEN greatest(0, least(4, ceil({c} / 25.0::DOUBLE)::INTEGER)) END"
    return f"""{name}_d AS (SELECT *, {d} FROM {source}), {name}_q AS (SELECT *, {q} FROM {name}_d),
{name}_m AS (SELECT *, ({' + '.join(qs)}) / {len(qs)}::DOUBLE AS "Q_mean", CASE WHEN {whole} THEN greatest({', '.join(qs)}) END AS "Q_max" FROM {name}_q),
{name}_i AS (SELECT *, CASE WHEN {whole} THEN greatest(0.0, {cfg.critical} - "Q_max") END AS delta FROM {name}_m),
{name}_v AS (SELECT *, CASE WHEN {whole} THEN greatest("Q_mean", "Q_max" - delta) END AS "I" FROM {name}_i),
{name} AS (SELECT *, {rank('"I"')} AS "class_I", {', '.join(f'{rank(q_)} AS "class_{c}"' for q_, c in zip(qs, cfg.components, strict=True))} FROM {name}_v)"""
