"""lodestack: analytics over versioned, content-addressed datasets, on Spark."""
