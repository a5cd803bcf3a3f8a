"""All queries of the memory engine by name, and the same in SQL."""

from .plans import analytics, indexes, ingest, mutations, retrieval, writes  # noqa: F401  (importing them registers their queries)
from .plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
