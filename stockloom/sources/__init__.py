"""Readers, projections of the given tables, and sinks."""
