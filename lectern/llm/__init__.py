"""Operators of a training-data pipeline: one module per operator, queries in ``queries``."""
