"""Training-data operators: search, filtering, deduplication, scoring, counting and mixing of text corpora.

Nothing outside this subpackage imports it.
"""
