"""millrace: duplicate detection and retrieval analytics as Spark DataFrame operators."""
