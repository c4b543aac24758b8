"""Queries over the driver's tables, each with its SQL where SQL can express it."""

from tidemark.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
