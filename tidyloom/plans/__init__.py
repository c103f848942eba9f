"""Compositions of the operators."""

from .keyed_table import keyed_table

__all__ = ["keyed_table"]
