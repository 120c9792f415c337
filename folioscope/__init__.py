"""Paper-corpus analytics as Spark DataFrame operators."""
