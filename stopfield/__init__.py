"""stopfield: transit level-of-service analytics expressed as Spark DataFrame operators."""
