"""Network telemetry analytics as Spark jobs."""
