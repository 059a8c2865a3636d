"""Operators for large text corpora: deduplication, decontamination, packing, scoring.

Nothing else in the library imports this subpackage, and it imports nothing from the
rest, so either side can be removed without touching the other.
"""
