"""The whole jobs: build the dataset, split it, evaluate models."""

from labelloom.plans.build import BuildResult, BuildSettings, build_dataset, save_build
from labelloom.plans.split import save_splits

__all__ = ["BuildResult", "BuildSettings", "build_dataset", "save_build", "save_splits"]
