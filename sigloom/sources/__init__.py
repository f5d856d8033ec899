"""Strict readers and sinks."""
