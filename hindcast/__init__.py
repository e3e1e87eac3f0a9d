"""Point-in-time analytics over timestamped transaction tables, as Spark jobs."""
