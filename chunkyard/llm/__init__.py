"""Training-data operators: licence scans, packing, deduplication, extraction, mixing, search, language ID, WARC.

Nothing outside this subpackage imports it. ``queries()`` and ``oracle_sql()`` list what the entry module registers.
"""


def queries():
    """The queries of this subpackage by name."""
    from chunkyard.llm import registry

    return registry.QUERIES


def oracle_sql():
    """DuckDB SQL for the queries of this subpackage that SQL can express."""
    from chunkyard.llm import registry

    return registry.ORACLE_SQL
