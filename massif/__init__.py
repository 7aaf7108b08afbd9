"""A PySpark engine for polygons over elevation rasters: zonal profiles, height hierarchies, trees, solids."""

__version__ = "0.1.0"
