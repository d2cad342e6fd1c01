"""All registered queries and the SQL they are compared with."""

from checks import definition_queries, graph_queries, lineage_queries, report_queries

_MODULES = [graph_queries, lineage_queries, report_queries, definition_queries]
QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
