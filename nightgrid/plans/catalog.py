"""Registered queries of the time-series engine and their SQL."""

from __future__ import annotations

from . import core, extra, files, kept, resampled, sequences, signals, statistics, trees  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "flagship_subject_report"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
