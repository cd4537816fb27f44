"""Training-data operators: filtering, deduplication, retrieval and packing of text corpora.

Nothing else in the package imports this subpackage.
"""
