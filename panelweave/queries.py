"""Registered queries over the test tables and their DuckDB equivalents."""

from panelweave.plans import backtest_queries, event_queries, filing_queries, inference_queries, model_queries, more_queries, panel_queries, research_queries, serving_queries  # noqa: F401
from panelweave.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
