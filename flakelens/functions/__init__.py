"""Column functions: no shuffle, no Python in the hot path."""
