"""Operators on frames: DataFrames with a row index ``idx`` (0, 1, 2, ... in each series) and optional key columns."""
