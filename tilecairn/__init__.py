"""Raster tables on Spark: one row a Web-Mercator tile, keyed by a sortable 64-bit cell id."""
