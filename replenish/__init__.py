"""Demand and replenishment analytics as Spark DataFrame operators."""

from replenish.params import Params

__all__ = ["Params"]
