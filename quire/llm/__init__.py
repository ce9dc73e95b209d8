"""Training-data operators: chat formatting, token files, deduplication, packing, scoring and tokenization.

Nothing else in the library imports this subpackage. ``queries`` registers one
query per operator; the modules beside it hold the operators themselves.
"""
