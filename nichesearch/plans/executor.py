"""Execution of candidates: every stage resolved, run, recorded; failures end a candidate, not a run.

A step is known by the digest of what goes into it: the contents of its tables (at first, of the source's
files), what earlier stages left beside them, its method, backend, parameters and seed. Its tables are artifacts, and the
next stage reads them back. With ``resume`` a step whose digest the store knows is not run again, whichever candidate or run
made it: a changed file, parameter or seed runs what depends on it anew, and nothing else.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict
from datetime import UTC, datetime
from importlib.metadata import PackageNotFoundError, version
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files
from ..functions.caching import hold, scope
from ..operators import surfaces
from ..schema import Artifact, Assumption, CandidatePlan, CandidateResult, DataSource, RealDataSource, RunManifest, RunResult, StepRecord, UnsupportedDataSource, UnsupportedStep
from ..sources import rasters
from ..sources.loader import SdmContext, load_data_source
from .catalogue import BackendRegistry
from .digest import digest_obj, tree_digests
from .store import ArtifactStore

BACKLOG = "code string, message string, feature string, requested_value string"
LINEAGE = "run_id string, candidate_id string, place int, stage string, inputs_digest string, step_digest string, reused boolean"
#: Of a context, what a kept step states as JSON.
_STATED = ("predictor_names", "height", "width", "occurrence_type", "transform", "crs", "has_dates")


def source_digest(spark: SparkSession, source: DataSource) -> str:
    """Of a source's settings, and of the names and contents of its files; a file that is not there counts as none."""

    def contents(path: str) -> list[Any]:
        try:
            found = sorted(r["digest"] for r in tree_digests(spark, path).collect())  # a source is a handful of files
        except Exception:  # whatever keeps Spark from reading it is the loader's to tell
            found = []
        return [PurePosixPath(path).name, found]

    stated = source.to_dict() | {"predictor_paths": [contents(p) for p in source.predictor_paths]}
    if isinstance(source, RealDataSource):
        stated["occurrences_path"] = contents(source.occurrences_path)[1]
    return digest_obj(stated)


class _Trace:
    """The records of one candidate; each is written as soon as it is made."""

    def __init__(self, plan: CandidatePlan, store: ArtifactStore, run_id: str):
        self.plan, self.store, self.run_id = plan, store, run_id
        self.steps: list[StepRecord] = []
        self.metrics: dict[str, float] = {}

    def add(self, stage: str, method: str, backend: str, inputs: str, began: float, key: str = "", reused: bool = False, **more) -> None:
        record = StepRecord(stage, self.plan.candidate_id, method, backend, inputs, self.plan.random_seed, time.perf_counter() - began, **more)
        place = len(self.steps)
        self.store.record(record, self.run_id, place)
        told = {"run_id": self.run_id, "candidate_id": self.plan.candidate_id, "place": place, "stage": stage, "inputs_digest": inputs, "step_digest": key, "reused": reused}
        files.save(self.store.spark, f"{self.store.root}/lineage/{self.run_id}/{self.plan.candidate_id}-{place:02d}.json", json.dumps(told).encode())
        self.steps.append(record)
        self.metrics |= record.metrics

    def failed(self, reason: str, *gaps: UnsupportedStep) -> CandidateResult:
        plan = self.plan.replace(unsupported_steps=(*self.plan.unsupported_steps, *gaps))
        return CandidateResult(plan, tuple(self.steps), failed=True, failure_reason=reason)

    def done(self) -> CandidateResult:
        return CandidateResult(self.plan, tuple(self.steps), self.metrics)


class _State:
    """A context whose tables are artifacts."""

    def __init__(self, spark: SparkSession, store: ArtifactStore):
        self.spark, self.store = spark, store
        self.context: SdmContext | None = None
        self.tables: dict[str, Artifact] = {}
        self.model: Artifact | None = None

    def digest(self) -> str:
        """Of all that the next stage can see."""
        stated = {c: getattr(self.context, c) for c in _STATED}
        return digest_obj([{t: a.digest for t, a in self.tables.items()}, stated, self.extra()])

    def extra(self) -> dict[str, Any]:
        return {k: v for k, v in self.context.extra.items() if k != "model"}

    def keep(self, stage: str, context: SdmContext, changed: tuple[str, ...], held: tuple[str, ...] = ()) -> tuple[Artifact, ...]:
        """Put the changed tables into the store; the next stage reads them from there. Those of ``held`` are filters over cached rows, which a second cache would repeat."""
        made = {t: self.store.put_table(f"{stage}.{t}", getattr(context, t) if t in held else hold(getattr(context, t))) for t in changed}
        self.tables |= made
        self.context = context.with_(**{t: self.store.read_table(self.spark, a) for t, a in made.items()})
        if (model := context.extra.get("model")) is not None and self.model is None:
            self.model = self.store.put_json(f"{stage}.model", {"model": surfaces.plain(model), "mean": context.extra.get("mean"), "sd": context.extra.get("sd"), "predictors": list(context.predictor_names)})
            return (*made.values(), self.model)
        return tuple(made.values())

    def state(self, metrics: dict[str, float], said: tuple[Assumption, ...], changed: tuple[str, ...]) -> dict[str, Any]:
        """What ``restore`` needs; a fitted model is an artifact."""
        return {
            "context": {c: getattr(self.context, c) for c in _STATED}, "extra": self.extra(), "tables": {t: asdict(a) for t, a in self.tables.items()},
            "model": self.model and asdict(self.model), "changed": list(changed), "metrics": metrics, "assumptions": [asdict(a) for a in said],
        }

    def restore(self, step: dict[str, Any]) -> tuple[dict[str, float], tuple[Assumption, ...], tuple[Artifact, ...]]:
        """The context after a kept step; its metrics, assumptions and artifacts."""
        self.tables = {t: Artifact(**a) for t, a in step["tables"].items()}
        stated = step["context"] | {"predictor_names": tuple(step["context"]["predictor_names"]), "transform": tuple(step["context"]["transform"]) if step["context"]["transform"] else None}
        self.context = SdmContext(*(self.store.read_table(self.spark, self.tables[t]) for t in ("grid", "occurrences")), **stated, extra=step["extra"])
        artifacts = tuple(self.tables[t] for t in step["changed"])
        if step["model"] and self.model is None:
            self.model = Artifact(**step["model"])
            artifacts = (*artifacts, self.model)
        return step["metrics"], tuple(Assumption(**a) for a in step["assumptions"]), artifacts


def execute_candidate(spark: SparkSession, plan: CandidatePlan, registry: BackendRegistry, store: ArtifactStore, run_id: str, resume: bool = False, inputs: str | None = None) -> CandidateResult:
    """Load, then stage after stage; what was cached on the way is released at the end. The fitted model is the last artifact of its step. ``inputs`` is the source's digest where it is known."""
    with scope():
        return _execute(spark, plan, registry, store, run_id, resume, inputs)


def _execute(spark: SparkSession, plan: CandidatePlan, registry: BackendRegistry, store: ArtifactStore, run_id: str, resume: bool, inputs: str | None) -> CandidateResult:
    trace, state = _Trace(plan, store, run_id), _State(spark, store)
    if not plan.is_executable:
        return trace.failed("a plan with unsupported steps is not run")
    began = time.perf_counter()
    inputs = inputs or source_digest(spark, plan.data_source)
    key = digest_obj(["data_source", inputs, plan.random_seed])
    if kept := store.kept_step(key) if resume else None:
        metrics, said, artifacts = state.restore(kept)
    else:
        try:
            context, assumed = load_data_source(spark, plan.data_source, plan.random_seed)
        except UnsupportedDataSource as e:
            return trace.failed(str(e), e.gap)
        artifacts = state.keep("data_source", context, ("grid", "occurrences"), ("occurrences",) if isinstance(plan.data_source, RealDataSource) else ())
        metrics, said = {"n_records": float(state.context.occurrences.count())}, tuple(assumed)
        store.keep_step(key, state.state(metrics, said, ("grid", "occurrences")))
    trace.add("data_source", plan.data_source.kind, "spark-source-loader", inputs, began, key, bool(kept), metrics=metrics, assumptions=said, artifacts=artifacts)
    for stage, spec in plan.methodology.steps():
        began, inputs = time.perf_counter(), state.digest()
        found = registry.resolve(stage, spec)
        if not found.ok:
            trace.add(stage, spec.method, "<unresolved>", inputs, began, params=spec.params, unsupported_steps=(found.gap,))
            return trace.failed(found.gap.message, found.gap)
        key = digest_obj([stage, inputs, spec.method, found.backend.name, spec.params, plan.random_seed])
        if kept := store.kept_step(key) if resume else None:
            metrics, said, artifacts = state.restore(kept)
        else:
            try:
                out = found.backend.run(spec, state.context, plan.random_seed)
                artifacts = state.keep(stage, out.context, out.tables)
            except Exception as e:  # of whatever kind: it is this candidate's failure
                trace.add(stage, spec.method, found.backend.name, inputs, began, params=spec.params)
                return trace.failed(f"{stage}/{spec.method} raised {type(e).__name__}: {e}")
            metrics, said = {str(k): float(v) for k, v in out.metrics.items()}, tuple(out.assumptions)
            store.keep_step(key, state.state(metrics, said, out.tables))
        trace.add(stage, spec.method, found.backend.name, inputs, began, key, bool(kept), params=spec.params, rationale=spec.source, metrics=metrics, assumptions=said, artifacts=artifacts)
    return trace.done()


def execute_run(
    spark: SparkSession, plans: list[CandidatePlan], registry: BackendRegistry, store: ArtifactStore, *, run_id: str, objective: str = "spatial_transfer", random_seed: int = 42, package_versions: dict[str, str] | None = None, resume: bool = False
) -> RunResult:
    """Run all candidates and write the run's record; none is selected here. With ``resume``, candidates share the steps that they have in common, with earlier runs in the store too."""
    sources = {s: source_digest(spark, s) for s in dict.fromkeys(p.data_source for p in plans)}  # files are hashed once a run
    contents = digest_obj(list(sources.values()))
    manifest = RunManifest(run_id, objective, contents, datetime.now(UTC).isoformat(), package_versions or _versions(), random_seed)
    store.record(manifest)
    result = RunResult(manifest, tuple(execute_candidate(spark, p, registry, store, run_id, resume, sources[p.data_source]) for p in plans))
    store.record(result)
    return result


def predicted_surface(spark: SparkSession, store: ArtifactStore, candidate: CandidateResult, folder: str) -> DataFrame:
    """A candidate's model over its whole grid, written as GeoTIFFs into a new ``folder`` and read back: (row, col, value). The grid and the model come from the store."""
    found = {a.name: a for s in candidate.step_records for a in s.artifacts}
    kept = json.loads(store.read_bytes(found["algorithm.model"]))
    source = candidate.plan.data_source
    head = rasters.read_predictors(spark, source.predictor_paths)
    cells = surfaces.surface(store.read_table(spark, found["data_source.grid"]), kept["model"], kept["mean"], kept["sd"])
    epsg = int((head.crs or "EPSG:4326").split(":")[1])
    rasters.write_surface(cells, folder, head.height, head.width, head.transform or (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), epsg)
    return rasters.read_surface(spark, folder)


def lineage(spark: SparkSession, store: ArtifactStore) -> DataFrame:
    """A row of ``LINEAGE`` for each step of each run in the store: what went in, what it is known by, whether it was read back."""
    return spark.read.schema(LINEAGE).json(f"{store.root}/lineage/*/*.json")


def _versions() -> dict[str, str]:
    found = {}
    for name in ("pyspark", "numpy", "pyarrow"):
        try:
            found[name] = version(name)
        except PackageNotFoundError:
            continue
    return found


def gaps_table(spark: SparkSession, result: RunResult) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(g)[c] for c in ("code", "message", "feature", "requested_value")) for g in result.unsupported_steps], BACKLOG)


def backlog(gaps: DataFrame) -> DataFrame:
    """Gaps ranked by how often they were met."""
    return gaps.groupBy("code", "feature", "requested_value").agg(F.count("*").alias("n"))


def assumption_counts(spark: SparkSession, result: RunResult) -> DataFrame:
    said: list[Assumption] = [a for c in result.candidates for s in c.step_records for a in s.assumptions]
    return spark.createDataFrame([(a.code, a.field) for a in said], "code string, field string").groupBy("code", "field").agg(F.count("*").alias("n"))
