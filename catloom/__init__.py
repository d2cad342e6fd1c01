"""Catalog profiling, code and report lineage, and a queryable governance graph on Spark."""
