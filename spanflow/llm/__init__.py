"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from spanflow.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
