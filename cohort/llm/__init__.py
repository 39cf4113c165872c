"""Operators for large training-data pipelines.

Nothing outside this package (but ``corpus_pipeline.py``) imports it.  Each module holds one operator
with a general interface; ``registry`` holds the thin ``opN_<name>`` queries over the given tables.
"""
