from . import catalog, file_queries, report_queries  # noqa: F401  (they register queries)
