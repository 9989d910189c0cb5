"""The registered queries, each beside the SQL that states its result."""

from colonnade.plans import (  # noqa: F401  (each module registers its queries)
    charts,
    columns,
    filtering,
    grouping,
    ingesting,
    merging,
    paging,
)
from colonnade.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
