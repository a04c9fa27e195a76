"""Attribute-based access control, its evidence and its evaluation, as Spark jobs."""
