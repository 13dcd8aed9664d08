"""Training-data operators: sharding, dedup, mixing, safety scans, archives.

Nothing outside this subpackage imports it; it may be deleted without effect on
the rest of the library.
"""
