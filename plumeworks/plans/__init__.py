"""Registered queries, content-keyed plans and intermediate tables.

QUERIES and ORACLES hold all registered queries and their SQL; they are loaded when first asked for,
as the operators use this package's intermediate tables.
"""


def __getattr__(name: str):
    if name in ("QUERIES", "ORACLES"):
        from . import batch_queries, dataset_queries, planning_queries, queries, record_queries, report_queries  # noqa: F401  (registers their queries)

        return getattr(queries, name)
    raise AttributeError(name)
