"""Operators for preparing language-model training data.

Nothing outside this folder (but the guarded lines of ``__spark_entry__.py`` and
``corpus_pipeline.py``) imports it, so it can be removed whole.
"""
