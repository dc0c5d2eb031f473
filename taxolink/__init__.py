"""Taxonomies, mapping tables and link graphs as Spark jobs."""
