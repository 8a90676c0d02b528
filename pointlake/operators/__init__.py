"""Joins, aggregations, object graphs, condensation, vector search, item processing."""
