"""DataFrame operators: DataFrames and keyword parameters in, a lazy DataFrame out."""
