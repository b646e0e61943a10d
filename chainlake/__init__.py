"""chainlake: options-snapshot analytics on Spark."""
