"""treelake: namespace-metadata analytics as set-at-a-time Spark jobs."""
