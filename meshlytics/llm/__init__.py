"""Operators that prepare text and vectors for language-model training, as Spark jobs."""
