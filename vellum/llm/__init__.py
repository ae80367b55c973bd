"""Training-data operators: scoring, packing, tokenizing, deduplication, secrets and archives.

Nothing outside this subpackage imports it.
"""
