"""Queries over rasters that are derived from the test tables."""
