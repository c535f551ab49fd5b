"""Marketplace order analytics as plain PySpark DataFrame operators."""

from mercato.sources.tables import Tables

__all__ = ["Tables"]
