"""Scenarios: parameters with their defaults, units, and the names of strategies and modes."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Strategies and the other names under which they are known.
STRATEGIES = ("largest_single_network", "most_connected_habitat", "landscape_fluidity", "reachable_habitat_advanced")
STRATEGY_ALIASES = {
    "largest_network": "largest_single_network",
    "single_network": "largest_single_network",
    "bigconnect": "most_connected_habitat",
    "lsn": "largest_single_network",
    "most_connected_area": "most_connected_habitat",
    "circuit_utility": "most_connected_habitat",
    "mca": "most_connected_habitat",
    "landscape_fluidity_a": "landscape_fluidity",
    "landscape_fluidity_a1": "landscape_fluidity",
    "fluidity": "landscape_fluidity",
    "lf": "landscape_fluidity",
    "reachable_habitat": "reachable_habitat_advanced",
    "habitat_availability": "reachable_habitat_advanced",
    "rh": "reachable_habitat_advanced",
}
DEFAULT_STRATEGY = "most_connected_habitat"
SCALINGS = {"sqrt": "sqrt", "square_root": "sqrt", "log": "log", "log1p": "log", "logarithmic": "log"}
KERNELS = {"exponential": "exponential", "exp": "exponential", "negative_exponential": "exponential"}
ASSIGNMENTS = {name: name for name in ("sum_direct_connected_patches", "sum_total_network_area", "efficiency")}
ASSIGNMENTS |= {"sum_patches_connected": "sum_direct_connected_patches", "newly_connected_area": "sum_total_network_area"}
#: Metres of a map unit, and conversions of areas.
METRES = {"metre": 1.0, "meter": 1.0, "m": 1.0, "foot": 0.3048, "feet": 0.3048, "ft": 0.3048, "us_survey_foot": 0.3048006096}
FOOT, ACRE_M2, ACRE_HA = 0.3048, 4046.8564224, 0.404685642


class ScenarioError(ValueError):
    """A scenario that can't be run as given."""


def key_of(value: object) -> str:
    """Lower case, blanks and hyphens as underscores."""
    return re.sub(r"[\s-]+", "_", str(value or "").strip().lower())


def named(value: object, names: dict[str, str], default: str) -> str:
    return names.get(key_of(value), default)


def strategy(value: object) -> str:
    """A strategy by name or alias; unknown ones are the default."""
    k = key_of(value)
    return k if k in STRATEGIES else STRATEGY_ALIASES.get(k, DEFAULT_STRATEGY)


def first_of(params: dict[str, Any], *names: str, default: Any = None, kind: type = str) -> Any:
    """The first parameter of these names that is neither null nor blank; what doesn't parse gives the default."""
    for name in names:
        if (v := params.get(name)) is not None and v != "":
            try:
                return kind(v)
            except (TypeError, ValueError):
                return default
    return default


def parse_numbers(text: str) -> list[float]:
    """Numbers of a comma list."""
    try:
        return [float(x) for x in text.split(",") if x.strip()]
    except ValueError as e:
        raise ScenarioError(f"not a list of numbers: {text!r}") from e


def map_unit_metres(unit: str) -> float | None:
    """Metres of a map unit; None where it isn't known."""
    return METRES.get(key_of(unit))


def to_cells(area: float, unit: str, cell_area_ha: float) -> int:
    """Area in hectares, acres or cells as whole cells, halves to even."""
    k = key_of(unit)
    if k in ("ha", "metric", "hectares"):
        return round(area / cell_area_ha)
    if k in ("ac", "imperial", "acres"):
        return round(area * ACRE_M2 / 10_000 / cell_area_ha)
    return round(area)


@dataclass(frozen=True)
class Scenario:
    """Parameters of a run. Names that no operator reads are accepted: min_patch_size, mobility_lambda_intra, mobility_tau."""

    scenario_id: str = "scenario"
    strategy: str = DEFAULT_STRATEGY
    patch_connectivity: int = 4
    patch_mode: str = "value"
    patch_values: tuple[float, ...] = ()
    range_lower: float | None = None
    range_upper: float | None = None
    obstacle_enabled: bool = False
    obstacle_mode: str = "value"
    obstacle_values: tuple[float, ...] = ()
    obstacle_range_lower: float | None = None
    obstacle_range_upper: float | None = None
    value_tolerance: float = 1e-6
    nodata_fallback: float = -9999.0
    min_patch_size: float = 30
    budget: float = 10
    max_search_distance: float = 50
    min_corridor_width: float = 1
    allow_bottlenecks: bool = True
    corridor_cell_assignment: str = "sum_total_network_area"
    pc_alpha: float = 1000.0
    pc_cutoff: float = 0.0
    sample_points: int = 50
    pair_samples: int = 200
    mobility_lambda_intra: float = 0.001
    mobility_tau: float = 0.9
    mobility_detour_cap: float = 8.0
    shortcut_threshold: float = 3.0
    weights: tuple[float, float, float, float] = (0.2, 0.2, 0.2, 0.2)
    redundancy_method: str = "ime"
    dispersal: float = 1000.0
    kernel: str = "exponential"
    scaling: str = "sqrt"
    min_species_area: float = 0.0
    extras: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        put("strategy", strategy(self.strategy))
        put("scaling", named(self.scaling, SCALINGS, "sqrt"))
        put("kernel", named(self.kernel, KERNELS, "exponential"))
        put("corridor_cell_assignment", named(self.corridor_cell_assignment, ASSIGNMENTS, "sum_total_network_area"))
        if self.patch_connectivity not in (4, 8):
            raise ScenarioError("patch_connectivity must be 4 or 8")
        if self.patch_mode == "range" and (self.range_lower is None or self.range_upper is None):
            raise ScenarioError("a range needs both bounds")
        if self.patch_mode == "value" and not self.patch_values:
            put("patch_values", ())
        put("sample_points", max(2, min(200, self.sample_points)))
        put("pair_samples", max(1, self.pair_samples))

    @property
    def alpha(self) -> float:
        return self.pc_alpha if self.pc_alpha > 0 else self.max_search_distance or 1000.0

    @property
    def cutoff(self) -> float:
        return max(self.alpha, self.pc_cutoff if self.pc_cutoff > 0 else 3 * self.alpha)

    def normal_weights(self) -> tuple[float, ...]:
        """Weights clipped at 0 and summing to 1; a quarter each where all are 0."""
        w = [max(0.0, x) for x in self.weights]
        return tuple(x / sum(w) for x in w) if sum(w) > 0 else (0.25,) * 4

    def in_metres(self, cell: float) -> Scenario:
        """Lengths and areas given in cells, as metres and hectares of cells of this size."""
        ha = cell * cell / 10_000
        return replace(self, budget=self.budget * ha, min_patch_size=self.min_patch_size * ha, max_search_distance=self.max_search_distance * cell, min_corridor_width=self.min_corridor_width * cell, dispersal=self.dispersal * cell)

    @classmethod
    def of(cls, params: dict[str, Any]) -> Scenario:
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in params.items() if k in known and v is not None}, extras={k: str(v) for k, v in params.items() if k not in known})


def scenarios(spark: SparkSession, runs: list[Scenario]) -> DataFrame:
    """One row for each scenario: (scenario_id, strategy, params)."""
    return spark.createDataFrame([(r.scenario_id, r.strategy, {k: str(v) for k, v in asdict(r).items() if k != "extras"} | r.extras) for r in runs], "scenario_id string, strategy string, params map<string,string>")
