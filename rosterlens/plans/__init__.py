"""Whole plans: the ranking pipeline, the result service, and the query catalogue."""
