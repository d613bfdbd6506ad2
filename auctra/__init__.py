"""Spark jobs for property-auction analytics."""
