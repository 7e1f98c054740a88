"""Sources to contexts: what is known of a dataset, the same for real and virtual ones."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.caching import hold
from ..schema import Assumption, CapabilityGap, DataSource, RealDataSource, UnsupportedDataSource, UnsupportedStep, VirtualDataSource
from . import occurrences, rasters, virtual


@dataclass(frozen=True)
class SdmContext:
    """The grid (row, col, predictors), the occurrences (record_id, row, col, label, obs_date), and what stages add."""

    grid: DataFrame
    occurrences: DataFrame
    predictor_names: tuple[str, ...]
    height: int
    width: int
    occurrence_type: str
    transform: tuple[float, ...] | None = None
    crs: str | None = None
    has_dates: bool = False
    extra: dict[str, Any] = field(default_factory=dict)  # mean, sd, accessible, model

    def with_(self, **changes: Any) -> SdmContext:
        return replace(self, **changes)

    @property
    def k(self) -> int:
        return len(self.predictor_names)


def load_data_source(spark: SparkSession, source: DataSource, seed: int) -> tuple[SdmContext, list[Assumption]]:
    """Raises UnsupportedDataSource with a typed gap rather than guess."""
    try:
        if isinstance(source, VirtualDataSource):
            return _virtual(spark, source, seed)
        return _real(spark, source)
    except CapabilityGap as e:
        raise UnsupportedDataSource(e.gap) from e


def _context(grid: rasters.Grid, occ: DataFrame, kind: str, has_dates: bool) -> SdmContext:
    return SdmContext(grid.cells, occ, grid.names, grid.height, grid.width, kind, grid.transform, grid.crs, has_dates)


def _real(spark: SparkSession, source: RealDataSource) -> tuple[SdmContext, list[Assumption]]:
    grid = rasters.read_predictors(spark, source.predictor_paths)
    occ, has_dates, said = occurrences.read_occurrences(spark, source.occurrences_path, grid, source.crs, source.date_field)
    return _context(grid, occ, source.occurrence_type, has_dates), said


def _virtual(spark: SparkSession, source: VirtualDataSource, seed: int) -> tuple[SdmContext, list[Assumption]]:
    if source.sampling_bias is not None:
        raise UnsupportedDataSource(UnsupportedStep("unsupported_sampling_bias", f"no generator for sampling bias {source.sampling_bias!r}", "sampling_bias", source.sampling_bias))
    grid = rasters.read_predictors(spark, source.predictor_paths)
    cells = hold(virtual.suitability(grid.cells, source.true_coefficients, source.true_intercept))
    missing = cells.filter("suitability is null").count()
    said = []
    if missing:
        said.append(Assumption("virtual_species_excluded_nodata_cells", f"{missing} cells lack a predictor and hold no simulated occurrence", "predictors"))
    total = grid.height * grid.width
    s = F.col("suitability")
    occ = virtual.draw(cells, s, source.n_presences, total, seed, "presence").withColumn("label", F.lit(1))
    if source.occurrence_type == "presence_absence":
        occ = occ.unionByName(virtual.draw(cells, 1 - s, source.n_absences, total, seed, "absence").withColumn("label", F.lit(0)))
    # only context columns go on: the niche that generated the species stays here
    occ = occ.select(F.xxhash64("row", "col", "label").alias("record_id"), "row", "col", "label", F.lit(None).cast("date").alias("obs_date"))
    return _context(grid, occ, source.occurrence_type, False), said
