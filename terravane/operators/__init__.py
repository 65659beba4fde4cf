"""Joins, aggregates, windows, geometry, graphs and snapshots on DataFrames."""
