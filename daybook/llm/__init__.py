"""Operators and queries of a training-data pipeline. Nothing outside imports this package."""
