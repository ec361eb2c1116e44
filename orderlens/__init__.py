"""Marketplace order analytics written as PySpark DataFrame operations."""

from orderlens.warehouse import Warehouse

__all__ = ["Warehouse"]
