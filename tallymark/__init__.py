"""Consistency analytics over document packages, expressed as Spark DataFrame queries."""
