"""Document retrieval, device telemetry and compliance analytics on Spark."""
