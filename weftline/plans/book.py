"""A book of queries: a function with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable:
        def put(f: Callable) -> Callable:
            n = name or f.__name__
            self.queries[n] = _ranks_as_long(f)
            if sql is not None:
                self.sql[n] = sql
            return f

        return put


def _ranks_as_long(f: Callable) -> Callable:
    """Window ranks are INT in Spark and BIGINT in SQL; queries return BIGINT."""

    @wraps(f)
    def run(spark, sf_dir):
        df = f(spark, sf_dir)
        ints = [c for c, t in df.dtypes if t == "int" and c in ("rank", "place")]
        return df.withColumns({c: df[c].cast("long") for c in ints}) if ints else df

    return run
