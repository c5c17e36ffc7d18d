"""Rasters in and out."""
