"""Score curves as parameters: tables of knots or analytic forms, turned into Columns.

The published curves of stop scores are inputs, not constants of this library; ``DEFAULT`` is this library's own plain choice.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from stopfield.functions.numeric import interpolate

Knots = tuple[tuple[float, ...], tuple[float, ...]]


@dataclass(frozen=True)
class ScoreCurves:
    """Stop score = mode factor x headway curve x speed curve, each to the power of its weight; a walk decays by (1 + d / scale)^-power."""

    mode: Mapping[str, float] = field(default_factory=lambda: {"bus": 0.7, "tram": 0.85, "rail": 1.0})
    headway: Knots = ((2.0, 10.0, 30.0, 60.0), (1.0, 0.7, 0.3, 0.1))
    speed: Knots = ((5.0, 20.0, 50.0), (0.2, 0.6, 1.0))
    walk_scale: Mapping[str, float] = field(default_factory=lambda: {"bus": 500.0, "tram": 700.0, "rail": 900.0})
    walk_power: float = 1.5
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    log_headway: bool = False

    def with_(self, **changes) -> ScoreCurves:
        return replace(self, **changes)

    def by_mode(self, table: Mapping[str, float], mode: Column) -> Column:
        out = F.when(F.lit(False), F.lit(0.0))
        for name, value in table.items():
            out = out.when(mode == name, F.lit(float(value)))
        return out

    @staticmethod
    def _power(c: Column, weight: float) -> Column:
        return c if weight == 1.0 else F.pow(c, F.lit(weight))

    def mode_score(self, mode: Column) -> Column:
        return self.by_mode(self.mode, mode)

    def headway_score(self, minutes: Column) -> Column:
        return interpolate(minutes, *self.headway, log_axis=self.log_headway)

    def speed_score(self, kmh: Column) -> Column:
        return interpolate(kmh, *self.speed)

    def stop_score(self, mode: Column, minutes: Column, kmh: Column) -> Column:
        a, b, c = self.weights
        return self._power(self.mode_score(mode), a) * self._power(self.headway_score(minutes), b) * self._power(self.speed_score(kmh), c)

    def walk(self, metres: Column, mode: Column) -> Column:
        return F.pow(1 + metres / self.by_mode(self.walk_scale, mode), F.lit(-self.walk_power))

    def value(self, metres: Column, mode: Column, minutes: Column, kmh: Column) -> Column:
        return self.stop_score(mode, minutes, kmh) * self.walk(metres, mode)


DEFAULT = ScoreCurves()


def hill(x: Column, anchor: float, power: float, bonus: float = 0.0) -> Column:
    """Saturating curve that is 1 at the anchor when ``bonus`` is the ceiling's excess over 1."""
    ratio = F.pow(x / anchor, F.lit(power))
    return (1 + bonus) * ratio / (bonus + ratio) if bonus else F.least(ratio, F.lit(1.0))
