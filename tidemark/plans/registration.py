"""Registration of queries with their DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..sources.tables import BASE_SQL


class Registry:
    def __init__(self, more_sql: str = "") -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}
        self.more = more_sql

    def __call__(self, sql: str | None, base: bool = True) -> Callable:
        """Register the function under its name, its SQL following the canonical frames.

        Sums of integers are 128 bits wide in DuckDB; they are cast to the 64 bits of Spark's.
        """

        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                text = re.sub(r"\bsum\(([^()]*)\) AS (?!DOUBLE)", r"CAST(sum(\1) AS BIGINT) AS ", sql)
                self.oracles[f.__name__] = (BASE_SQL + self.more + text) if base else text
            return f

        return add
