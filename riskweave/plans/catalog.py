"""All registered queries."""

from riskweave.plans import (  # noqa: F401
    q_aggregates,
    q_columns,
    q_contracts,
    q_evaluation,
    q_graph,
    q_joins,
    q_scorers,
    q_sources,
)
from riskweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
