"""The pandas-compatible layer: Spark's own, reached from frames.

Names that this module lacks come from ``pyspark.pandas``, so that
``from lakeloom import pandas_layer as pd`` can stand in for pandas over
distributed data.
"""

from __future__ import annotations

from typing import Any

from lakeloom.frame import Frame


def _layer():
    import pyspark.pandas as ps

    return ps


def __getattr__(name: str) -> Any:
    if name.startswith("__"):
        raise AttributeError(name)
    return getattr(_layer(), name)


def from_frame(frame: Frame, index_col: Any = None):
    """A pandas-like frame over the rows of a :class:`Frame`."""
    return frame.to_pandas_on_spark(index_col)


def to_frame(data: Any, index_col: Any = None) -> Frame:
    """Back to a :class:`Frame`; the index becomes columns if it is named."""
    return Frame(data.to_spark(index_col))


def read_snapshot(table: str, index_col: Any = None):
    """A table's rows as a pandas-like frame."""
    return _layer().read_table(table, index_col)
