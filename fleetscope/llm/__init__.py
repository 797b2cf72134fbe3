"""Operators of a training-data pipeline, and their queries over the shared test tables."""
