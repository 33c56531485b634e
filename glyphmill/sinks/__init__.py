"""Sinks of the text-quality engine."""
