"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it; it imports nothing of the rest.
"""
