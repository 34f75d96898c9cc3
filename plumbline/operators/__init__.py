"""Table operators: DataFrames in, one DataFrame out."""
