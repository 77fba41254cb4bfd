"""Training-data operators: mixing, extraction, cleaning, deduplication, decontamination.

Nothing outside this subpackage (and ``corpus_pipeline``, which belongs to it) imports it.
"""
