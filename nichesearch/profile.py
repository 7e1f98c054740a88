"""A dataset's profile: volume, spacing, sampling, environment and time, measured repeatably."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .functions.caching import hold, scope
from .operators import profile_stats as stats
from .operators import stages
from .schema import Assumption, Record
from .sources.loader import SdmContext


@dataclass(frozen=True)
class VolumeProfile(Record):
    n_records: int
    n_unique_cells: int
    n_presences: int
    n_absences: int
    prevalence: float | None
    duplicate_fraction: float


@dataclass(frozen=True)
class SpatialProfile(Record):
    extent_cells: int
    extent_rows: int
    extent_cols: int
    occupied_cells: int
    coverage_fraction: float
    autocorrelation_range_cells: float
    autocorrelation_range_bounded: bool
    nearest_neighbour_index: float
    mean_nearest_neighbour_cells: float


@dataclass(frozen=True)
class SamplingProfile(Record):
    environmental_coverage: float
    covariate_shift: float
    max_univariate_shift: float


@dataclass(frozen=True)
class EnvironmentalProfile(Record):
    n_predictors: int
    max_abs_correlation: float
    max_vif: float
    effective_dimensionality: float
    niche_breadth: float | None


@dataclass(frozen=True)
class TemporalProfile(Record):
    n_dated_records: int
    span_days: int
    first_date: str
    last_date: str
    median_records_per_year: float


@dataclass(frozen=True)
class DataProfile(Record):
    volume: VolumeProfile
    spatial: SpatialProfile
    sampling: SamplingProfile
    environmental: EnvironmentalProfile
    temporal: TemporalProfile | None = None

    @property
    def is_small_sample(self) -> bool:
        return self.volume.n_unique_cells < 50

    @property
    def is_spatially_clustered(self) -> bool:
        return self.spatial.nearest_neighbour_index < 0.8

    def suggested_block_size(self, min_blocks_per_side: int = 4) -> int:
        """At least the autocorrelation range, but so small that a side has a few blocks."""
        most = max(1, min(self.spatial.extent_rows, self.spatial.extent_cols) // min_blocks_per_side)
        return max(1, min(math.ceil(self.spatial.autocorrelation_range_cells), most))


def build_profile(ctx: SdmContext, seed: int = 42) -> tuple[DataProfile, list[Assumption]]:
    """A handful of aggregations, each collected as one small row; the source is read once for all."""
    with scope():
        return _measured(ctx.with_(grid=hold(ctx.grid), occurrences=hold(ctx.occurrences)), seed)


def _measured(ctx: SdmContext, seed: int) -> tuple[DataProfile, list[Assumption]]:
    said: list[Assumption] = []
    grid, occ, k = ctx.grid, ctx.occurrences, ctx.k
    valid = stats.valid_cells(grid)
    extent = valid.count()
    v = stats.volume(occ, ctx.occurrence_type == "presence_absence").first()
    volume = VolumeProfile(**v.asDict())
    cells = hold(occ.select("row", "col").distinct())
    near = stats.spacing(cells, extent).first()
    reach, bounded = stats.variogram_range(stats.variogram(grid, k, seed).collect(), min(extent, stats.VARIOGRAM_CELLS))
    if not bounded:
        said.append(Assumption("autocorrelation_range_unbounded", f"the semivariogram has no sill by {reach:.0f} cells: the range is a lower bound, and blocks can't separate folds wholly", "profile.spatial"))
    spatial = SpatialProfile(
        extent_cells=extent,
        extent_rows=ctx.height,
        extent_cols=ctx.width,
        occupied_cells=volume.n_unique_cells,
        coverage_fraction=volume.n_unique_cells / extent if extent else 0.0,
        autocorrelation_range_cells=reach,
        autocorrelation_range_bounded=bounded,
        nearest_neighbour_index=near["nearest_neighbour_index"],
        mean_nearest_neighbour_cells=near["mean_nearest_neighbour_cells"],
    )
    landscape = stats.sample_cells(valid, stats.LANDSCAPE_CELLS, seed, "landscape").select("row", "col", "predictors").cache()
    at = stages.gather(occ, grid)
    sampled = at.filter(stages.complete("predictors"))
    lost = volume.n_records - sampled.count()
    if lost:
        said.append(Assumption("profile_excluded_nodata_records", f"{lost} records lie on cells without a predictor and don't count in the environmental profile", "profile"))
    moved = stats.shift(sampled, landscape, k).first()
    touched = stages.gather(cells, grid).filter(stages.complete("predictors"))  # bins that records touch are those of their cells
    sampling = SamplingProfile(stats.coverage(touched, landscape, k).first()[0], moved["covariate_shift"] or 0.0, moved["max_univariate_shift"] or 0.0)
    matrix = np.eye(k)
    for r in stats.correlation(landscape, k).collect():
        matrix[r["i"], r["j"]] = r["r"]
    high, vif, dimensions = stats.collinearity(matrix)
    environmental = EnvironmentalProfile(k, high, vif, dimensions, stats.niche_breadth(sampled, landscape, k).first()[0])
    time = None
    if ctx.has_dates:
        t = stats.temporal(occ).first()
        if t["n_dated_records"]:
            time = TemporalProfile(t["n_dated_records"], t["span_days"], str(t["first_date"]), str(t["last_date"]), t["median_records_per_year"])
        else:
            said.append(Assumption("no_usable_dates", "there is a date column, but none of its values can be read", "profile.temporal"))
    landscape.unpersist()
    return DataProfile(volume, spatial, sampling, environmental, time), said


