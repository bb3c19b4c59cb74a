"""Registered queries of the library proper, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from . import change_queries, dependency_queries, install_queries, policy_queries, project_queries, python_version_queries, review_queries, revision_queries, scan_queries, source_queries, taint_queries, tree_queries

MODULES = (scan_queries, dependency_queries, review_queries, source_queries, install_queries, change_queries, policy_queries, tree_queries, project_queries, taint_queries, python_version_queries, revision_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
