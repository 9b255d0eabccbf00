"""Farsight: regulatory horizon scanning as Spark DataFrame jobs."""

from farsight.session import stage_dir, staged, tune

__all__ = ["stage_dir", "staged", "tune"]
