"""Whole clusterings, and the registry of queries."""
