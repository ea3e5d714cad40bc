"""Settings as frozen dataclasses; they end up as literals in Column expressions. Values here are the documented defaults."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

INDICATORS = ("pm25", "pm10", "co2", "t", "rh")
COMPONENTS3 = {"A": ("pm25", "pm10"), "V": ("co2",), "M": ("t", "rh")}
COMPONENTS4 = {"A": ("pm25",), "P": ("pm10",), "V": ("co2",), "M": ("t", "rh")}
CLASSES5 = ("EXCELLENT", "GOOD", "MODERATE", "LOW", "CRITICAL")
CLASSES4 = ("Favourable", "Acceptable", "Degraded", "Critical")


@dataclass(frozen=True)
class Breakpoints:
    """Five limits above the normal range and, for two-sided indicators, five below it."""

    high: tuple[float, ...]
    low: tuple[float, ...] | None = None

    def __post_init__(self):
        for b, up in ((self.high, True), (self.low, False)):
            if b is not None and (len(b) != 5 or any((x >= y) if up else (x <= y) for x, y in zip(b, b[1:], strict=False))):
                raise ValueError(f"five strictly {'in' if up else 'de'}creasing limits are needed: {b}")


def co2_limits(outdoor: float, deltas: tuple[float, ...] = (550.0, 800.0, 1350.0), critical: float = 2000.0) -> tuple[float, ...]:
    """Outdoor level plus deltas, the critical limit, and one more step of the last width."""
    b = [outdoor + d for d in deltas] + [critical]
    return (*b, 2 * b[3] - b[2])


@dataclass(frozen=True)
class IndexConfig:
    # Class limits of the additive index.
    limits: dict = field(
        default_factory=lambda: {
            "pm25": Breakpoints((15.0, 25.0, 37.5, 50.0, 62.5)),
            "pm10": Breakpoints((45.0, 50.0, 75.0, 100.0, 125.0)),
            "co2": Breakpoints(co2_limits(420.0)),
            "t": Breakpoints((25.5, 26.0, 27.0, 28.0, 29.0), (21.0, 20.0, 18.0, 16.0, 14.0)),
            "rh": Breakpoints((50.0, 60.0, 70.0, 80.0, 90.0), (30.0, 25.0, 20.0, 15.0, 10.0)),
        }
    )
    pm10_separate: bool = False
    critical: float = 75.0
    dominance_from: float = 25.0
    dominance_tolerance: float = 1.0

    @property
    def components(self) -> dict[str, tuple[str, ...]]:
        return COMPONENTS4 if self.pm10_separate else COMPONENTS3

    def variant(self, pm10_separate: bool | None = None, t_low: tuple[float, ...] | None = None, co2_outdoor: float | None = None) -> IndexConfig:
        limits = dict(self.limits)
        if t_low is not None:
            limits["t"] = Breakpoints(limits["t"].high, tuple(t_low))
        if co2_outdoor is not None:
            limits["co2"] = Breakpoints(co2_limits(co2_outdoor))
        return replace(self, limits=limits, pm10_separate=self.pm10_separate if pm10_separate is None else pm10_separate)


@dataclass(frozen=True)
class QualityConfig:
    # Cadence, windows, detectors.
    cadence_s: int = 30
    tolerance_s: int = 15
    window_min: int = 15
    recompute_min: int = 5
    coverage_min: float = 0.8
    hampel_window: int = 11
    hampel_k: float = 3.0
    stuck_repeats: int = 5
    drift_steps: int = 5
    drift_factor: float = 3.0
    persist: int = 2
    pm_tolerance: float = 0.20
    outdoor_max_age_min: int = 120


@dataclass(frozen=True)
class FuzzyConfig:
    # Class boundaries and transition widths of the two-level index.
    pm2_5: tuple = ((15.0, 25.0, 50.0), 5.0)
    pm10: tuple = ((45.0, 75.0, 100.0), 25.0)
    co2: tuple = ((800.0, 1000.0, 1500.0), 70.0)
    output: tuple = ((25.0, 50.0, 75.0), 2.0)
    #: edges from the low critical limit up to the high one: crit | deg | acc | fav | acc | deg | crit
    humidity: tuple = ((20.0, 25.0, 30.0, 50.0, 60.0, 70.0), 3.0)
    temperature: tuple = ((15.5, 16.5, 18.0, 21.0, 22.5, 23.5), 0.5)
    points: int = 401


#: Technical range, declared uncertainty of each channel of the 30-second readings. Fixed values.
CHANNELS = {
    "pm2_5": (0.0, 1000.0, 5.0),
    "pm10": (0.0, 1000.0, 25.0),
    "co2": (400.0, 40000.0, 70.0),
    "temperature": (-40.0, 85.0, 0.5),
    "humidity": (0.0, 100.0, 3.0),
}
#: Device status -> state it forces. Fixed values.
STATUS = {"ok": "VALID", "partial": "VALID", "failed": "INVALID", "disabled": "MISSING", "data_not_ready": "MISSING"}


def identity(*configs) -> str:
    """SHA-256 over the settings, a lineage key."""
    return hashlib.sha256(json.dumps([asdict(c) for c in configs], sort_keys=True, default=str).encode()).hexdigest()
