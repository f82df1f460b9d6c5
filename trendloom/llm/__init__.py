"""Operators of a large training-data pipeline (see the README's table).

Nothing outside this package imports it; ``queries.py`` holds the registered
queries and ``corpus_pipeline.py`` at the repository top chains five operators.
"""
