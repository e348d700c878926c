"""tidelog: versioned, replicated keyed state as Spark DataFrames."""
