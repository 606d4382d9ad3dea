"""Relational operators on tile indexes, runs and metrics."""
