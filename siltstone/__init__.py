"""A Spark-first engine for query provenance and relational analytics."""
