"""Registered queries over the shared tables, and the SQL that gives the same rows."""

from . import calibration, checks, evaluation, laps, models, simulation, sources, streams  # noqa: F401  (add their queries to the catalogue)
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
