"""Reading and writing tables of tiles."""
