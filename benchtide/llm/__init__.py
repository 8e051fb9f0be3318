"""Training-data operators: cleaning, deduplication, scoring, packing.

Nothing else in the package imports this subpackage.
"""
