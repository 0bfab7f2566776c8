"""Spark-first cohort analytics: assembly, features, fusion, stability, search and inference as DataFrame plans."""
