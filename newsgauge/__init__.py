"""Media and survey analytics on Spark: coverage, vocabulary, retrieval evaluation and framing statistics."""
