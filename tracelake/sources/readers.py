"""Readers of sources by name, those of plugins included."""

from __future__ import annotations

from collections.abc import Callable

from tracelake.config import register_source
from tracelake.sources import atif_exports, canonical, mlflow_exports, observation_exports, rollout_exports, run_exports
from tracelake.sources.common import Snapshot

Reader = Callable[..., Snapshot]
READERS: dict[str, Reader] = {
    "canonical": canonical.read, "runs": run_exports.read, "observations": observation_exports.read, "mlflow": mlflow_exports.read, "atif": atif_exports.read,
    "rollouts": lambda spark, path: rollout_exports.read(spark, path)[0],
}


def register(name: str, read: Reader, *needs: str) -> None:
    """Add a source: read(spark, one argument for each option that it needs, limit and others by name) gives a Snapshot."""
    register_source(name, list(needs) or ["path"])
    READERS[name] = read
