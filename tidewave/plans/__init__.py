"""Join strategies that Spark has no operator for."""
