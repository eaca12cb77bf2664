"""Readers, source filters and sinks."""
