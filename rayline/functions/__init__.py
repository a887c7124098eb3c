"""Column functions: geometry, names, text, JSON, raster rays."""
