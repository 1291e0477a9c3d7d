"""Named queries: DataFrames in, lazy DataFrame out."""
