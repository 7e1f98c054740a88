"""What happened in a run, for people and for reruns: step cards and provenance."""

from __future__ import annotations

from html import escape
from typing import Any

from pyspark.sql import SparkSession

from ..schema import Artifact, RealDataSource, RunResult, StepRecord
from .digest import digest_files
from .store import ArtifactStore


def step_card(record: StepRecord) -> str:
    """One step as a page of HTML."""

    def table(title: str, rows: list[tuple[Any, ...]]) -> str:
        cells = "".join("<tr>" + "".join(f"<td>{escape(str(x))}</td>" for x in row) + "</tr>" for row in rows)
        return f"<h2>{escape(title)}</h2><table>{cells}</table>" if rows else ""

    parts = [
        table("Step", [("stage", record.stage), ("method", record.method), ("backend", record.backend), ("seed", record.random_seed), ("seconds", f"{record.duration_seconds:.3f}"), ("inputs", record.inputs_digest), ("because of", record.rationale or "-")]),
        table("Parameters", sorted(record.params.items())),
        table("Metrics", sorted(record.metrics.items())),
        table("Assumptions", [(a.code, a.message) for a in record.assumptions]),
        table("Gaps", [(g.code, g.message) for g in record.unsupported_steps]),
        table("Artifacts", [(a.name, a.path, a.digest) for a in record.artifacts]),
    ]
    title = escape(f"{record.candidate_id}: {record.stage}")
    return f"<!doctype html><meta charset='utf-8'><title>{title}</title><h1>{title}</h1>{''.join(parts)}"


def put_cards(store: ArtifactStore, result: RunResult) -> list[Artifact]:
    return [store.put_bytes(f"{r.candidate_id}.{r.stage}.card", step_card(r).encode(), "text/html", ".html") for c in result.candidates for r in c.step_records]


def provenance(spark: SparkSession, result: RunResult) -> dict[str, Any]:
    """Digests of the files that candidates read, versions and seeds. Files that aren't there have none."""
    paths = {p for c in result.candidates for p in (*c.plan.data_source.predictor_paths, *([c.plan.data_source.occurrences_path] if isinstance(c.plan.data_source, RealDataSource) else []))}
    found: dict[str, list[str]] = {}
    for path in sorted(paths):
        try:
            found[path] = sorted(r["sha256"] for r in digest_files(spark, path).collect())  # a source is a handful of files
        except Exception:  # whatever keeps Spark from reading it
            found[path] = []
    return {"run_id": result.manifest.run_id, "files": found, "package_versions": result.manifest.package_versions, "seeds": {c.plan.candidate_id: c.plan.random_seed for c in result.candidates}}
