"""Incremental and streaming upkeep of the graph."""
