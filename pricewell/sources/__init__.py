"""Readers, page shredding and sinks."""
