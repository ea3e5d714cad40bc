"""Checks of the fuzzy settings: transition widths against sensor uncertainty, shapes of membership functions, grid sizes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CHANNELS, CLASSES4, FuzzyConfig
from . import fuzzy

NARROW = ("pm2_5", "pm10", "co2", "humidity", "temperature")


@dataclass(frozen=True)
class Adjustment:
    channel: str
    configured: float
    required: float


def validate_widths(cfg: FuzzyConfig, policy: str = "reject") -> tuple[FuzzyConfig, list[Adjustment]]:
    """Every input's transition must be at least as wide as its sensor's declared uncertainty.

    reject: ValueError that lists the narrow ones. auto_expand: settings with them widened, and what was changed. The index
    itself has no sensor and is not checked.
    """
    if policy not in ("reject", "auto_expand"):
        raise ValueError(f"unknown policy {policy}")
    found = [Adjustment(c, getattr(cfg, c)[1], CHANNELS[c][2]) for c in NARROW if getattr(cfg, c)[1] < CHANNELS[c][2]]
    if policy == "reject" and found:
        raise ValueError("transitions narrower than the sensor's uncertainty: " + ", ".join(f"{a.channel} {a.configured} < {a.required}" for a in found))
    return replace(cfg, **{a.channel: (getattr(cfg, a.channel)[0], a.required) for a in found}), found


def shape_kind(a: float, b: float, c: float, d: float) -> str:
    """shoulder, trapezoidal, triangular, or crossed."""
    if b == -fuzzy._INF or c == fuzzy._INF:
        return "shoulder"
    return "trapezoidal" if b < c else "triangular" if b == c else "crossed"


def shapes(cfg: FuzzyConfig) -> list[tuple]:
    """(channel, class, side, a, b, c, d, plateau, kind) of every membership function."""
    made = {c: fuzzy.monotonic_shapes(*getattr(cfg, c)) for c in ("pm2_5", "pm10", "co2", "output")}
    made |= {c: fuzzy.two_sided_shapes(*getattr(cfg, c)) for c in ("humidity", "temperature")}
    out = []
    for channel, classes in made.items():
        for name, sides in zip(CLASSES4, classes, strict=True):
            for k, (a, b, c, d) in enumerate(sides):
                finite = b != -fuzzy._INF and c != fuzzy._INF
                out.append((channel, name, k, *(None if abs(x) == fuzzy._INF else float(x) for x in (a, b, c, d)), float(c - b) if finite else None, shape_kind(a, b, c, d)))
    return out


def coverage(cfg: FuzzyConfig) -> dict[str, list[str]]:
    """Per one-sided channel: neighbouring classes that do not meet exactly, and limits out of order."""
    out = {}
    for channel in ("pm2_5", "pm10", "co2", "output"):
        limits, _ = getattr(cfg, channel)
        sides = [s[0] for s in fuzzy.monotonic_shapes(*getattr(cfg, channel))]
        bad = [f"{x} before {y}" for x, y in zip(limits, limits[1:], strict=False) if x >= y]
        for k, (one, two) in enumerate(zip(sides, sides[1:], strict=False)):
            if abs(one[2] - two[0]) > 1e-9 and fuzzy._INF not in (abs(one[2]), abs(two[0])):
                bad.append(f"{'gap' if two[0] > one[2] else 'overlap'} between class {k} and {k + 1}")
        out[channel] = bad
    return out


def scenario_family(scenario: Column) -> Column:
    """A scenario's name without the suffix of its part."""
    return F.regexp_replace(scenario, "_(calibration|validation)$", "")


def scenario_split(scenario: Column) -> Column:
    return F.when(F.endswith(scenario, F.lit("_validation")), "validation").otherwise("calibration")


def grid_is_whole(points: int, rows: int) -> bool:
    """A grid of three components with `points` values each has their cube as rows."""
    return rows == points**3
