"""Registered queries by family, each with the SQL that checks it where SQL can say it."""

from hazegrid.plans.catalog import (  # noqa: F401
    aggregates, expressions, files, joining, learning, live, windows,
)
from hazegrid.plans.catalog.registry import ORACLES, QUERIES  # noqa: F401
