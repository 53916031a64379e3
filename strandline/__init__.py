"""Network and validator analytics as composable Spark DataFrame functions."""
