"""Training-data operators: deduplication, packing, quality, language, tokens, extraction.

Nothing else in the library imports this subpackage.
"""
