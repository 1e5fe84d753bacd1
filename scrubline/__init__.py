"""scrubline: Spark-first operators that find and remove sensitive or repeated content."""
