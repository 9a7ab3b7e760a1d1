"""Operators of a training-data pipeline.  Nothing else in skarn imports this subpackage."""
