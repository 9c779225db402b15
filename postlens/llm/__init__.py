"""Training-data operators: dedup, quality, tokenisation, extraction, mixing.

Self-contained: nothing else in the library imports this subpackage.
"""
