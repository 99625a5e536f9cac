"""Operators of a training-data pipeline: deduplication, archives, decontamination, scoring, mixing.

Nothing else in the library imports this subpackage. ``queries`` registers one query per
operator; ``load()`` fills ``QUERIES`` and ``ORACLES``.
"""
