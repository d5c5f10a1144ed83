"""Scalar expressions over pixels, coordinates and polygons."""
