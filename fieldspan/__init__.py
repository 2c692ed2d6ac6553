"""Panel productivity analytics as Spark DataFrame transformations."""
