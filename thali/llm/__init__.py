"""Operators of a training-data pipeline (packing, near-dedup, formatting, scoring, ...).

Nothing else in the library imports this subpackage; it may be removed as a whole.
"""
