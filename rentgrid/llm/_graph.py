"""Distributed union-find: the library's star contraction."""

from rentgrid.operators.graph import components

__all__ = ["components"]
