"""Readers and writers."""

from groundphrase.sources.tables import table

__all__ = ["table"]
