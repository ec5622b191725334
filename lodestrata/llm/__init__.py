"""Operators of a training-data pipeline; each module holds one operator and documents its edge cases.

Nothing outside this folder (but ``corpus_pipeline.py`` and the guarded lines of ``__spark_entry__.py``) imports it.
"""
