"""The backends that come with the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.caching import hold
from ..operators import algorithms, stages
from ..profile import DataProfile, build_profile
from ..schema import Assumption, MethodSpec
from ..sources.loader import SdmContext
from .catalogue import Backend, BackendRegistry, StageOutput

PROFILE_STAGE = "profile"


class StandardProfiler(Backend):
    name, stage, methods = "spark-profile-standard", PROFILE_STAGE, ("standard",)

    def run(self, spec: MethodSpec, context: SdmContext, seed: int) -> tuple[DataProfile, list[Assumption]]:
        return build_profile(context, seed)


class DropDuplicateCells(Backend):
    name, stage, methods = "spark-clean-duplicates", "cleaning", ("drop_duplicate_cells",)

    def run(self, spec: MethodSpec, context: SdmContext, seed: int) -> StageOutput:
        kept = hold(stages.drop_duplicate_cells(context.occurrences))
        before, after = context.occurrences.count(), kept.count()
        if not before:
            raise ValueError("there are no occurrences to clean")
        return StageOutput(context.with_(occurrences=kept), {"n_records": float(after), "n_dropped": float(before - after)}, (), ("occurrences",))


class FullExtent(Backend):
    name, stage, methods = "spark-area-full-extent", "accessible_area", ("full_extent",)

    def run(self, spec: MethodSpec, context: SdmContext, seed: int) -> StageOutput:
        return StageOutput(context.with_(grid=stages.full_extent(context.grid)), {}, (), ("grid",))


class StandardisePredictors(Backend):
    name, stage, methods = "spark-predictors-standardise", "predictors", ("standardize", "standardise")

    def run(self, spec: MethodSpec, context: SdmContext, seed: int) -> StageOutput:
        mean, sd = stages.layer_stats(context.grid, context.k)
        rows = hold(stages.standardise(context.occurrences, context.grid, mean, sd))
        lost = rows.filter("features is null").count()
        said = (Assumption("dropped_records_with_missing_predictors", f"{lost} records lie on cells without a predictor", "predictors"),) if lost else ()
        context = context.with_(occurrences=rows.filter("features is not null"), extra=context.extra | {"mean": mean, "sd": sd})
        return StageOutput(context, {"n_predictors": float(context.k)}, said, ("occurrences",))


class RandomBackground(Backend):
    name, stage, methods = "spark-background-random", "background", ("random",)

    def run(self, spec: MethodSpec, context: SdmContext, seed: int) -> StageOutput:
        wanted = int(spec.params.get("n_background", 5000))
        grid = context.grid if "accessible" in context.grid.columns else stages.full_extent(context.grid)
        there = grid.filter("accessible").count()
        said = [Assumption("background_capped_by_extent", f"{wanted} background points are wanted, {there} cells accessible", "background.n_background")] if wanted > there else []
        drawn = stages.random_background(grid, min(wanted, there), seed)
        z = hold(drawn.withColumn("features", stages.scaled("predictors", context.extra["mean"], context.extra["sd"])))
        whole = z.filter(stages.complete("features"))
        n, all_n = whole.count(), z.count()
        if n < all_n:
            said.append(Assumption("background_dropped_missing_predictors", f"{all_n - n} background cells lack a predictor", "background"))
        rows = whole.select(F.xxhash64(F.lit("background"), "row", "col").alias("record_id"), "row", "col", F.lit(0).alias("label"), F.lit(None).cast("date").alias("obs_date"), "features")
        occ = context.occurrences.select(rows.columns).unionByName(rows)
        return StageOutput(context.with_(occurrences=occ), {"n_background": float(n)}, tuple(said), ("occurrences",))


class RandomKFold(Backend):
    name, stage, methods = "spark-split-random-kfold", "split", ("random_kfold",)

    def run(self, spec: MethodSpec, context: SdmContext, seed: int) -> StageOutput:
        n = int(spec.params.get("n_folds", 5))
        return StageOutput(context.with_(occurrences=stages.random_kfold(context.occurrences, n, seed)), {"n_folds": float(n)}, (), ("occurrences",))


class SpatialBlockSplit(Backend):
    name, stage, methods = "spark-split-spatial-block", "split", ("spatial_block",)

    def run(self, spec: MethodSpec, context: SdmContext, seed: int) -> StageOutput:
        n, size = int(spec.params.get("n_folds", 5)), int(spec.params.get("block_size", 10))
        rows = stages.spatial_block_folds(context.occurrences, size, n, seed)
        blocks = rows.select("block_row", "block_col").distinct().count()
        said = (Assumption("fewer_blocks_than_folds", f"{blocks} blocks of size {size} can't fill {n} folds", "split.n_folds"),) if blocks < n else ()
        return StageOutput(context.with_(occurrences=rows.drop("block_row", "block_col")), {"n_folds": float(n), "n_blocks": float(blocks)}, said, ("occurrences",))


class _Learner(Backend):
    stage = "algorithm"

    def run(self, spec: MethodSpec, context: SdmContext, seed: int) -> StageOutput:
        scored, metrics, model, said = algorithms.cross_validate(context.occurrences, self.methods[0], spec.params, seed)
        return StageOutput(context.with_(occurrences=scored, extra=context.extra | {"model": model}), metrics, tuple(said), ("occurrences",))


class Logistic(_Learner):
    name, methods = "spark-logistic", ("logistic", "glm")


class GradientBoosting(_Learner):
    name, methods = "spark-gbm", ("gbm", "brt")


class MaximumEntropy(_Learner):
    """Not among the default methods; see ``extended_registry``."""

    name, methods = "spark-maxent", ("maxent",)


class GeneralisedAdditive(_Learner):
    """Not among the default methods; see ``extended_registry``."""

    name, methods = "spark-gam", ("gam",)


class AdaptiveSplines(_Learner):
    """Not among the default methods; see ``extended_registry``."""

    name, methods = "spark-mars", ("mars",)


BUILTIN_BACKENDS: tuple[Backend, ...] = (StandardProfiler(), DropDuplicateCells(), FullExtent(), StandardisePredictors(), RandomBackground(), RandomKFold(), SpatialBlockSplit(), Logistic(), GradientBoosting())


def default_registry() -> BackendRegistry:
    return BackendRegistry(*BUILTIN_BACKENDS)


def extended_registry() -> BackendRegistry:
    """The default methods, and those beyond them."""
    return BackendRegistry(*BUILTIN_BACKENDS, MaximumEntropy(), GeneralisedAdditive(), AdaptiveSplines())


def profile_context(context: SdmContext, registry: BackendRegistry, spec: MethodSpec | None = None, seed: int = 42) -> tuple[DataProfile | None, list[Assumption]]:
    """The profile by a registered profiler; None if there is none of that name."""
    spec = spec or MethodSpec("standard")
    found = registry.resolve(PROFILE_STAGE, spec)
    return found.backend.run(spec, context, seed) if found.backend else (None, [])
