"""Operators for large training corpora: scoring, dedup joins, packing, tokens, privacy.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
