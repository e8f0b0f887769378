"""A Spark-first library for research on market-style bar data."""
