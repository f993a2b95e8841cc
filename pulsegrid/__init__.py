"""PulseGrid: attention analytics as Spark DataFrame, SQL, Structured Streaming and Spark ML jobs."""
