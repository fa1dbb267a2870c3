"""Payment-risk analytics as composable Spark DataFrame jobs."""
