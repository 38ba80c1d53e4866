"""Operators of a training-data pipeline: scanning, mixing, removal of repeats, scoring.

Each module holds one operator with its own interface; ``queries`` applies them to
whole tables. Nothing else in the library imports this subpackage.
"""
