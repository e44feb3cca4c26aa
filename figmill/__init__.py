"""Figure and document structure as DataFrames."""
