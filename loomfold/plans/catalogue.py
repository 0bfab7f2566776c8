"""All queries of the cohort engine."""

from __future__ import annotations

from . import cohort, derived, exact, files, large, modelling, recodes, resampling, statistics

MODULES = (resampling, statistics, cohort, recodes, files, modelling, exact, large, derived)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
