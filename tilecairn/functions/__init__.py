"""Column functions: cells, Mercator tiles, pixels, statistics, time."""
