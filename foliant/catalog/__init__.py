"""All named queries; importing this package fills the registry."""

from foliant.catalog import maintenance, reading, searching, timelines  # noqa: F401
from foliant.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
