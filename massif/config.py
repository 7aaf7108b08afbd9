"""Engine parameters and their validation."""

import math
from dataclasses import dataclass, fields, replace


class InputError(ValueError):
    """The input or a parameter can't be used."""


class ValidationError(ValueError):
    """A result breaks an invariant."""


@dataclass(frozen=True)
class EngineConfig:
    id_field: str | None = None
    working_crs: str = "EPSG:32750"
    output_crs: str = "EPSG:4326"
    height_diff_threshold_m: float = 3.0
    min_subregion_area_m2: float = 12.0
    min_building_height_m: float = 2.0
    base_elevation_stat: str = "min"
    ground_source_type: str = "DTM"
    vertical_datum: str | None = None
    max_height_classes: int = 4
    min_footprint_change_ratio: float = 0.25
    morph_closing_iters: int = 3
    max_fill_hole_area_m2: float = 4.0
    parent_min_containment_ratio: float = 0.5
    regularize: bool = False
    simplify_tolerance_m: float = 0.9
    rectangular_ratio: float = 0.4
    circularity_threshold: float = 0.8
    keep_properties: tuple[str, ...] | None = None
    raster_drivers: tuple[str, ...] | None = None
    round_digits: int = 2
    coord_digits: int = 8
    mode: str = "building"
    min_tree_height: float = 0.2
    max_bio_height_m: float = 45.0
    trunk_ratio: float = 0.35
    split_clusters: bool = True
    cluster_min_area_m2: float = 35.0
    itd_min_distance_m: float = 2.5
    wood_density: float = 0.57
    carbon_fraction: float = 0.47

    def __post_init__(self):
        from massif.functions import projection

        limits = {"max_height_classes": (1, 32), "morph_closing_iters": (0, 100), "round_digits": (0, 15), "coord_digits": (0, 15)}
        for name, (low, high) in limits.items():
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
                raise InputError(f"{name} must be a whole number from {low} to {high}, not {value!r}")
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type is float and (isinstance(value, bool) or not math.isfinite(value) or value < 0):
                raise InputError(f"{f.name} must be finite and not negative, not {value!r}")
            ratio = f.name.endswith("_ratio") or f.name in ("circularity_threshold", "carbon_fraction")
            if ratio and value > 1:
                raise InputError(f"{f.name} must be at most 1, not {value!r}")
        if self.mode == "building" and not projection.metric(projection.code(self.working_crs)):
            raise InputError(f"working_crs must be a projected system in metres, not {self.working_crs}")
        for name, allowed in {"base_elevation_stat": ("min", "mean", "median"), "ground_source_type": ("DTM", "DEM"), "mode": ("building", "tree"), "output_crs": ("EPSG:4326",)}.items():
            if getattr(self, name) not in allowed:
                raise InputError(f"{name} must be one of {', '.join(allowed)}, not {getattr(self, name)!r}")

    def override(self, **given) -> "EngineConfig":
        """Unknown names are errors; None keeps what is there."""
        unknown = sorted(set(given) - {f.name for f in fields(self)})
        if unknown:
            raise InputError(f"unknown parameters: {', '.join(unknown)}")
        return replace(self, **{k: v for k, v in given.items() if v is not None})
