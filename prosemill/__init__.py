"""Text-corpus analytics on Spark: DataFrame, SQL and Structured Streaming plans."""
