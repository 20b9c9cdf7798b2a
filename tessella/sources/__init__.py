"""Observations and centres as DataFrames: sources, scans, sinks."""
