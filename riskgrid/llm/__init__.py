"""Operators of a large-scale training-data pipeline (each module is one operator)."""
