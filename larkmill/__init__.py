"""larkmill: a Spark-first analytics engine with a compact SQL dialect."""
