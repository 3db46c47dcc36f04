"""Batch jobs on Spark for indexing, searching and evaluating large collections of drawings."""
