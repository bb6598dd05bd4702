"""Payment-risk analytics as Spark DataFrame work."""
