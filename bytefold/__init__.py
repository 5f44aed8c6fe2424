"""bytefold: a Spark-first analytics engine for large sets of binary memory images."""

__version__ = "0.1.0"
