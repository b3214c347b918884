"""Where query modules register a query and its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from capturelake.sources.capture_view import with_packets


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query, sql: str | None = None, packets: bool = True) -> None:
        """``packets``: the SQL reads the capture view."""
        self.queries[name] = query
        if sql:
            self.sql[name] = with_packets(sql) if packets else sql


def text(column: str) -> Column:
    """An array as comma-joined text."""
    return F.array_join(F.transform(F.col(column), lambda x: x.cast("string")), ",").alias(column)
