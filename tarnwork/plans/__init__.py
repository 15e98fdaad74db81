"""Named queries over the demonstration tables, with the SQL that gives the same rows."""

from tarnwork.plans import curation, linking, prescriptions, recognition, records, replies, trends  # noqa: F401  register their queries
from tarnwork.plans.analytics import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
