"""DataFrame operators of the cohort engine."""
