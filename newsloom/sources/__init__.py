"""Readers and writers."""

from newsloom.sources.tables import table

__all__ = ["table"]
