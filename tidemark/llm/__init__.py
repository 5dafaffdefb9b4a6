"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it; ``queries`` registers its entry points.
"""
