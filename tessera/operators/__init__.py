"""Operators on rasters: clip, reproject, overviews, zonal statistics."""
