"""A Spark-first code-graph analytics engine."""
