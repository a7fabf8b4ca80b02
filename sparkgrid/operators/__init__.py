"""Operators over rasters as relations."""
