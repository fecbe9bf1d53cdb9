"""Training-data operators: quality, dedup, extraction, packing, tokenisation, search.

Nothing outside this subpackage imports it.  ``registry`` maps query names to callables and oracle SQL.
"""
