"""Document retrieval and answer-quality jobs as plain Spark DataFrame functions."""
