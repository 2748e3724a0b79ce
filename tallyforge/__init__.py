"""Catalog quality and training-corpus operators as Spark jobs."""
