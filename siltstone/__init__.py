"""siltstone: content analytics as Spark DataFrame operators."""
