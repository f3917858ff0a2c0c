"""Study parameters as one immutable value that every plan takes."""

from __future__ import annotations

from dataclasses import dataclass, field

from stopfield.functions.curves import DEFAULT, ScoreCurves


@dataclass(frozen=True)
class StudyParams:
    """Defaults of the studies; change one with ``dataclasses.replace``."""

    day_start: int = 6 * 3600
    day_end: int = 22 * 3600
    day_type: str = "weekday"
    stop_group_metres: float = 150.0
    street_metres: float = 125.0
    move_metres: float = 300.0
    fill_metres: float = 80.0
    walk_metres: float = 2000.0
    far_metres: float = 15000.0
    far_slots: int = 15
    min_density_km2: float = 10.0
    rescale_warn_share: float = 0.05
    fine_res: int = 18
    coarse_res: int = 15
    curves: ScoreCurves = field(default_factory=lambda: DEFAULT)
