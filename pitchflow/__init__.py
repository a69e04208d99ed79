"""Spark jobs over football tracking data, keyed by match."""
