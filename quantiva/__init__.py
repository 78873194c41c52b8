"""Spark-first quantity analytics: parsing, matching, computing and reconciling building quantities."""
