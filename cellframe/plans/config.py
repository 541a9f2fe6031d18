"""Typed settings of a job, read from a plain mapping, and the folders of its outputs."""

from __future__ import annotations

import dataclasses
import posixpath
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from ..functions.expr import Soil

#: Fixed: the outputs of a job and the file each one has by default; those of the terrain stage go to the folder of derived bands.
BANDS = {"slope": "slope", "specific_catchment_area": "specific_catchment_area", "topographic_driving_index": "topographic_driving_index"}
RESULTS = {"c_model_mean": "c_model_mean", "pci": "pci", "source_polygons": "source_polygons"}


@dataclass(frozen=True)
class Draws:
    n_samples: int = 1500
    seed: int = 42


@dataclass(frozen=True)
class Terrain:
    fill_sinks: bool = True
    flow_director: str = "D8"

    def neighbours(self) -> int:
        """8 or 4; ``D8``, or ``D4`` and its other name ``steepest``, in any case."""
        known = {"D8": 8, "D4": 4, "STEEPEST": 4}
        if self.flow_director.upper() not in known:
            raise ValueError(f"flow_director is one of {', '.join(known)}, not {self.flow_director}")
        return known[self.flow_director.upper()]


@dataclass(frozen=True)
class SourceArea:
    """Selections of source cells. Fixed: the default values."""

    erosion_threshold_m: float = -0.277
    use_dod_filter: bool = True
    top_percent_values: tuple[float, ...] = (10, 5)
    c_min_values: tuple[float, ...] = (5, 10, 20, 30, 50, 70)
    c_channel_max: float | None = 120
    min_polygon_area_m2: float | None = None
    dem_diff: str | None = None


@dataclass(frozen=True)
class Outputs:
    pci_threshold: float = 0.7
    min_area_m2: float = 0.0


@dataclass(frozen=True)
class Paths:
    dem: str | None = None
    dem_diff: str | None = None
    processed_dir: str = "data/processed"
    output_dir: str = "data/outputs"


def default_inputs() -> dict[str, dict]:
    """Fixed: how the three inputs are drawn where a job doesn't say."""
    return {
        "d50": {"mode": "distribution", "distribution": "lognormal", "mean": 2.0, "std": 0.48, "units": "mm"},
        "na": {"mode": "distribution", "distribution": "uniform", "min": 0.015, "max": 0.10, "units": "manning"},
        "rainfall_excess": {"mode": "distribution", "distribution": "uniform", "min": 15.0, "max": 55.0, "units": "mm/hr"},
    }


@dataclass(frozen=True)
class Settings:
    """All that a job reads. ``inputs`` has a spec for each of ``d50``, ``na`` and ``rainfall_excess``; ``places`` the outputs that have a path of their own."""

    soil: Soil = Soil(n1=0.7)
    alpha: float = 1.167
    draws: Draws = Draws()
    inputs: Mapping[str, dict] = field(default_factory=default_inputs)
    source_area: SourceArea = SourceArea()
    terrain: Terrain = Terrain()
    outputs: Outputs = Outputs()
    paths: Paths = Paths()
    places: Mapping[str, str] = field(default_factory=dict)
    root: str = "."

    def place(self, path: str) -> str:
        """A path of the job; one that is no address and doesn't start at a root lies below the job's own."""
        return path if "://" in path else posixpath.join(self.root, path)

    def output(self, name: str) -> str:
        """Where the output of that name is written."""
        if name in self.places:
            return self.place(self.places[name])
        if name in BANDS:
            return self.place(posixpath.join(self.paths.processed_dir, BANDS[name]))
        return self.place(posixpath.join(self.paths.output_dir, RESULTS.get(name, name)))

    def change_band(self) -> str:
        """The band of elevation change, which the paths or else the selections name."""
        named = self.paths.dem_diff or self.source_area.dem_diff
        if not named:
            raise ValueError("set paths.dem_diff or source_area.dem_diff")
        return self.place(named)

    def least_area(self) -> float:
        """The smallest source polygon that stays: as the selections say, else as all outputs do."""
        own = self.source_area.min_polygon_area_m2
        return float(self.outputs.min_area_m2 if own is None else own)


def overlaid(section: Any, given: Mapping | None):
    """A section with the fields that a mapping gives; a list counts as a tuple, other names in it are for someone else."""
    known = {f.name for f in dataclasses.fields(section)}
    chosen = {k: tuple(v) if isinstance(v, list) else v for k, v in (given or {}).items() if k in known}
    return dataclasses.replace(section, **chosen)


def job_settings(own: Mapping | None = None, root: str = ".") -> Settings:
    """Settings of a job from the mapping that its file holds: sections ``parameters``, ``monte_carlo``, ``inputs`` (or ``c_sampling``),
    ``source_area``, ``terrain``, ``outputs`` and ``paths``, each one and each field of it optional. An input that is given replaces the
    default one whole. ``root`` is the folder that relative paths start from."""
    own, plain = own or {}, Settings()
    parameters = own.get("parameters") or {}
    named = own.get("outputs") or {}
    return Settings(
        soil=overlaid(plain.soil, parameters),
        alpha=float(parameters.get("alpha", plain.alpha)),
        draws=overlaid(plain.draws, own.get("monte_carlo")),
        inputs={**plain.inputs, **(own.get("c_sampling") or {}), **(own.get("inputs") or {})},
        source_area=overlaid(plain.source_area, own.get("source_area")),
        terrain=overlaid(plain.terrain, own.get("terrain")),
        outputs=overlaid(plain.outputs, named),
        paths=overlaid(plain.paths, own.get("paths")),
        places={k: v for k, v in named.items() if k in BANDS or k in RESULTS},
        root=root,
    )


def first_existing(paths: list[str], exists: Callable[[str], bool]) -> str:
    """The first path that is there; else the first one."""
    return next((p for p in paths if exists(p)), paths[0])
