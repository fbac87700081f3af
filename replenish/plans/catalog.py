"""All named queries (importing the modules registers them)."""

from replenish.plans import basics, decisions, release, series, streams  # noqa: F401
from replenish.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
