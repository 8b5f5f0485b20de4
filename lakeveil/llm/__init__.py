"""Training-data operators: quality, deduplication, sharding, mixing, scoring, packing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
