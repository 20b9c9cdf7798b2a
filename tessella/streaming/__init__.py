"""Clusterings of streams."""
