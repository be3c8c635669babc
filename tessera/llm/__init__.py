"""Training-data operators: deduplication, mixing, search, tokens, languages.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
