"""Intermediate tables of the operators: see ``opskpi.staging``."""

from opskpi.staging import Staging, scratch

__all__ = ["Staging", "scratch"]
