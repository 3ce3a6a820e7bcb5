"""Spark jobs over event streams, kept as tables or live."""
