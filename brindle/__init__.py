"""brindle: retrieval, vector search, clustering and evaluation as Spark DataFrame plans."""
