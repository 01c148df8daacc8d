"""A Spark-first multi-model SQL engine."""
