"""Operators of a training-data pipeline; nothing outside imports this subpackage."""
