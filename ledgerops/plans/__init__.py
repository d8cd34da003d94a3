"""Registered queries (``catalog``), their inputs and oracle SQL."""

from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
