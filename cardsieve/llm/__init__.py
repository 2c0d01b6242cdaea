"""Training-data operators: language-model scoring, vector search, filtering, packing and near-duplicate detection.

Nothing outside this package imports it.
"""
