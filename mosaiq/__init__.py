"""mosaiq: comparative text retrieval and corpus processing on Spark DataFrames."""
