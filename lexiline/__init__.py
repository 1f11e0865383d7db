"""Term detection and word timelines as Spark DataFrame operators."""
