"""Threatloom: a PySpark engine that scores tables of texts and agent events
for security threats."""

__version__ = "0.1.0"
