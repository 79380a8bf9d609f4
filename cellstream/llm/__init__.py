"""Training-data operators: language, privacy, duplicates, search, tokens, packing and filters.

Nothing outside this subpackage imports it.
"""
