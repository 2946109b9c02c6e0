"""Data-quality operators for Spark tables."""
