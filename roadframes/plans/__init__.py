"""Composed jobs, models and the query catalogue."""
