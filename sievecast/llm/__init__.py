"""Training-data operators: language ID, LM scoring, mixing, near-duplicates, search, quality, tokens.

Nothing outside this package imports it.
"""
