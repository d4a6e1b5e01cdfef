"""Operators for large training corpora: dedup, archives, packing, sharding, decontamination, filters.

Nothing else in the library imports this package.
"""
