"""Customer-value analytics on sparse daily activity panels, written for Spark."""
