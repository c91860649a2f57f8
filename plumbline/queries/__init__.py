"""All registered queries and their SQL texts."""

from plumbline.queries import features, models, quality, tables  # noqa: F401  (they register their queries)
from plumbline.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
