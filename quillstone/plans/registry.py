"""All registered queries with their DuckDB counterparts."""

from . import columns, comparison, coordinates, diagnostics, external, learned, models, pairs, rows, validation  # noqa: F401
from .register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
