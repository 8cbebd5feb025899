"""drawspark: a Spark-first engine for discrete-draw analytics."""
