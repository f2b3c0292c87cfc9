"""All queries over the shared tables, with the SQL each must agree with."""

from quarry.plans import choosing, deciding, discovery, graphs, knowledge, passing, projecting, running, scoring, searching, sourcing, states, viewing, views  # noqa: F401
from quarry.plans.discovery import relationship_rank  # noqa: F401
from quarry.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
