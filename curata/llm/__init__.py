"""Training-data operators: language, quality, deduplication, fingerprints, packing and tokenising.

Nothing else in the library imports this subpackage; it may be deleted as a whole.
"""
