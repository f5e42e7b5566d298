"""Operators for building training data at scale.

Nothing else in :mod:`lakeloom` imports this subpackage.
"""
