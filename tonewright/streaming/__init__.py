"""The row-local operators applied to unbounded DataFrames."""
