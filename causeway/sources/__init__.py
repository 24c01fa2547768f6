"""Readers and writers."""

from causeway.sources.tables import table

__all__ = ["table"]
