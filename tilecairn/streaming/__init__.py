"""Tables of tiles from streams."""
