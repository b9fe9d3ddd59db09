"""Solar-fleet telemetry analytics expressed as Spark jobs."""
