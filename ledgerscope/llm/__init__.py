"""Training-data operators: mixing, deduplication, scoring, extraction, archiving and packing.

Nothing else in the library imports this subpackage.
"""
