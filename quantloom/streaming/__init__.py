"""Daily cross-sections of a stream of bars."""
