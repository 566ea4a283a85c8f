"""Training-data operators: extraction, deduplication, filtering, packing, archives.

Self-contained: nothing outside this folder imports it.
"""
