"""All registered queries."""

from . import inquiry, intake, plates, quality, stewardship, vision  # noqa: F401  (registration)
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
