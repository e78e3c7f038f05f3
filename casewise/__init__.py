"""Security-log forensics as Spark DataFrame and Structured Streaming jobs."""
