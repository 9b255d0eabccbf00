"""Registered queries over the driver tables, each with its SQL for comparison."""

from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
