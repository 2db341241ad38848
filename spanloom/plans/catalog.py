"""All queries by name, and their SQL."""

from . import algebra, building, queries

__all__ = ["algebra", "building"]

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
layer_histogram = queries.layer_histogram
