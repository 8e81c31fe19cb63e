"""Training-data operators: near duplicates, search, packing, filtering, mixing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
