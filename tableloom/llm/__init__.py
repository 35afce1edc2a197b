"""Training-data operators: deduplication, packing, mixing, sharding, scoring.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
