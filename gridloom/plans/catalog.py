"""All registered queries: importing this fills the registry."""

from gridloom.plans import formula_queries, grid_queries, harness_queries, session_queries, workbook_queries  # noqa: F401
from gridloom.plans.registry import ORACLES, QUERIES  # noqa: F401
