"""Spanloom: string diagrams as DataFrames, for Spark."""
