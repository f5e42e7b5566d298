"""Analytics on Spark DataFrames: relational operators, functions, sources, tables and streams."""

from lakeloom.column import Case, Col
from lakeloom.frame import AsyncJob, Frame
from lakeloom.operators.grouping import Grouped, GroupingSets
from lakeloom.session import Session
from lakeloom.table import Table, when_matched, when_not_matched
from lakeloom.window import Window

__all__ = ["AsyncJob", "Case", "Col", "Frame", "Grouped", "GroupingSets", "Session", "Table", "Window", "when_matched", "when_not_matched"]
