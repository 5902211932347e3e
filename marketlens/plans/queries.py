"""All queries on market data. Importing this module registers them."""

from . import fold_queries, message_queries, relational_queries, scalar_queries, time_queries  # noqa: F401
from .catalog import ORACLE_SQL, QUERIES  # noqa: F401
