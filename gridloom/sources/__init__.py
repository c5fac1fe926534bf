"""Readers, parsers and sinks of landed files and canonical tables."""
