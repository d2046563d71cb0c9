"""Training-data operators: deduplication, filtering, packing and archive formats over documents and pages.

Nothing outside this subpackage imports it.
"""
