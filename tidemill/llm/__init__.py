"""Operators for training data: packing, deduplication, mixing, classifiers, scans, scoring, media and fingerprints.

Nothing else in the library imports this subpackage.
"""
