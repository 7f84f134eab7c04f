"""Operators over tables of tiles."""
