"""Operators for large training-data pipelines: each module is one operator, its queries are in `queries`."""
