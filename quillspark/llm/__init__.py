"""Training-data operators: sharding, near-dedup, filters, mixing, tokens, search.

Every module has one operator with its own general interface; ``queries``
holds the thin ``opN_*`` queries.  Nothing outside this subpackage imports it.
"""
