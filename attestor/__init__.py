"""Evidence retrieval and its evaluation as Spark DataFrame plans."""
