"""Runs of equal values in the order of a key's rows, as a table function for SQL: ``TABLE(...) PARTITION BY ... ORDER BY ...``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


class _Runs:
    """Holds one open run, whatever the length of a key's rows: Spark sorts them, and a finished run is emitted at once. Nulls are equal to each other."""

    def __init__(self) -> None:
        self.run: list | None = None

    def eval(self, row: Row) -> Iterator[tuple]:
        if self.run and self.run[:2] == [row["key"], row["value"]]:
            self.run[2] += 1
            self.run[4] = row["at"]
            return
        if self.run:
            yield tuple(self.run)
        self.run = [row["key"], row["value"], 1, row["at"], row["at"]]

    def terminate(self) -> Iterator[tuple]:
        if self.run:
            yield tuple(self.run)


def register(spark: SparkSession, name: str = "value_runs") -> str:
    """Register the function for tables of key, value and at; its rows are key, value, n, first and last (of ``at``)."""
    spark.udtf.register(name, udtf(_Runs, returnType="key bigint, value string, n bigint, first timestamp, last timestamp"))
    return name
