"""Operators for large text corpora: packing, filtering, search, formats, dedup, sharding."""
