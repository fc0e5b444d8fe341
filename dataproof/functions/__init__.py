"""Column-level building blocks; everything here returns Spark expressions."""
