"""Training-data operators: the numbered steps of a large text pipeline as Spark jobs."""
