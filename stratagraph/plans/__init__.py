"""Registered queries and their SQL."""

from . import catalogue, extended, searches  # noqa: F401
