"""Document-intake and review analytics as Spark DataFrame operators."""
