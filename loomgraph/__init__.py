"""loomgraph: a Spark-first engine for ranking a shared web graph."""
