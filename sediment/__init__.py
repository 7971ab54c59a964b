"""Text processing and hybrid retrieval on PySpark."""
