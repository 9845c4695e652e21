"""Connected components of a links table."""

from ..operators.components import components

__all__ = ["components"]
