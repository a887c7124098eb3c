"""Sources: case files, rasters, remote services that fill lookup tables, configuration."""
