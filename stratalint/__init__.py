"""stratalint: code-health analytics over source trees, as Spark DataFrames."""
