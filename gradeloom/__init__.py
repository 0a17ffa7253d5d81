"""gradeloom: a Spark-first engine for assessment analytics and document data processing."""
