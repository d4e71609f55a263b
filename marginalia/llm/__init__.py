"""Training-data operators: archives, deduplication, mixing, tokenising, search, classification and scans.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds ``registry.QUERIES`` when it is present.
"""
