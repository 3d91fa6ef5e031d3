"""Corpus operators for training-data pipelines: deduplication, scoring, mixing and packing.

Nothing outside this folder imports it. ``entries.queries()`` lists its registered queries.
"""
