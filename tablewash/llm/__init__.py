"""Operators for large-scale training-data pipelines, one module each.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its
queries (``queries.py``) when it can be imported.
"""
