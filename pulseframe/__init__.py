"""Event and forcing analytics as declarative Spark operators."""
