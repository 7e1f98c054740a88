"""Spark-native search over species-distribution-modelling methodologies."""

import sys

from pyspark import cloudpickle

from .plans.builtin import BUILTIN_BACKENDS, default_registry, profile_context
from .plans.catalogue import Backend, BackendRegistry, Resolution
from .plans.executor import execute_candidate, execute_run
from .plans.priors import DEFAULT_PRIORS, Condition, Prior
from .plans.proposer import explain, propose
from .plans.store import ArtifactStore
from .profile import DataProfile, EnvironmentalProfile, SamplingProfile, SpatialProfile, TemporalProfile, VolumeProfile, build_profile
from .schema import (
    SCHEMA_VERSION,
    Artifact,
    Assumption,
    CandidatePlan,
    CandidateResult,
    DataSource,
    MethodologySpec,
    MethodSpec,
    Objective,
    OccurrenceType,
    RealDataSource,
    RunManifest,
    RunResult,
    SelectionScore,
    StepRecord,
    UnsupportedDataSource,
    UnsupportedStep,
    VirtualDataSource,
)
from .sources.loader import SdmContext, load_data_source

#: Executors get this package's functions by value: they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "BUILTIN_BACKENDS",
    "DEFAULT_PRIORS",
    "SCHEMA_VERSION",
    "Artifact",
    "ArtifactStore",
    "Assumption",
    "Backend",
    "BackendRegistry",
    "CandidatePlan",
    "CandidateResult",
    "Condition",
    "DataProfile",
    "DataSource",
    "EnvironmentalProfile",
    "MethodSpec",
    "MethodologySpec",
    "Objective",
    "OccurrenceType",
    "Prior",
    "RealDataSource",
    "Resolution",
    "RunManifest",
    "RunResult",
    "SamplingProfile",
    "SdmContext",
    "SelectionScore",
    "SpatialProfile",
    "StepRecord",
    "TemporalProfile",
    "UnsupportedDataSource",
    "UnsupportedStep",
    "VirtualDataSource",
    "VolumeProfile",
    "build_profile",
    "default_registry",
    "execute_candidate",
    "execute_run",
    "explain",
    "load_data_source",
    "profile_context",
    "propose",
]
