"""Raster files: ranges of bytes, TIFF headers, scans and sinks."""
