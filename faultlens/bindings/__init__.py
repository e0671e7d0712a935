"""Queries over the given tables: one per operator, with the equivalent SQL where SQL can express it."""

from faultlens.bindings import cleaning, evaluation, features, grids, labels, scoring, streams  # noqa: F401
from faultlens.bindings.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
