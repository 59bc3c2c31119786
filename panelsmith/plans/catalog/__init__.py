"""All registered queries, by topic."""

from panelsmith.plans.catalog import (  # noqa: F401 - importing registers
    column_queries,
    evaluation_queries,
    model_queries,
    neighbor_queries,
    panel_queries,
    statistics_queries,
)
from panelsmith.plans.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
