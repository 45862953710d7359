"""Place and clickstream analytics as Spark DataFrame operators."""
