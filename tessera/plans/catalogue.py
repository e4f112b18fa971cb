"""All queries over the driver's tables, with the SQL that gives the same rows."""

from tessera.plans import queries_merge, queries_more, queries_relational, queries_scalar, queries_sources, queries_temporal  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "direct_owner"
