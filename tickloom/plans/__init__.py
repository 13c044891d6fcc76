"""Registered queries with their SQL."""

from . import features, indicators, market, reports, strategy  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
