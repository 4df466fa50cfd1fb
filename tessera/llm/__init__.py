"""Training-data operators: deduplication, privacy, tokens, packing, language, quality, shards.

Nothing else in the package imports this subpackage.
"""
