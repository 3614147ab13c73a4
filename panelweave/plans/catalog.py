"""All registered queries."""

from panelweave.plans import (  # noqa: F401
    flow_queries,
    graph_queries,
    pair_queries,
    panel_queries,
    source_queries,
    text_queries,
)
from panelweave.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
