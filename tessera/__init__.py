"""A Spark-first engine for governed SQL, graph patterns, vectors and text corpora."""
