"""docsift: batch retrieval, corpus analytics and evaluation as Spark DataFrame plans."""
