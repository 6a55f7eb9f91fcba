"""Daily results from a stream of levels."""
