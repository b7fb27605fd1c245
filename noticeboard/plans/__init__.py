"""Queries bound to the given tables.  Importing the modules registers them."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import answers, discovery, facts, items, lifecycle, ops, textual  # noqa: F401,E402
