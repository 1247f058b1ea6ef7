"""Training-data operators: deduplication, scoring, packing, extraction and filtering of documents.

Nothing else in the library imports this subpackage.
"""
