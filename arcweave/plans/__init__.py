"""Composed queries, lineage control and the registered query set."""
