"""Rewrites that the optimizer cannot find by itself."""
