"""Training-data operators: filtering, deduplication, mixing, packing, sharding and archives.

Nothing outside this package imports it, so it can be removed as a whole.
"""
