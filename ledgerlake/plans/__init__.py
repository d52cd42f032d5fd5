"""Whole jobs: views over source tables, and the daily run."""
