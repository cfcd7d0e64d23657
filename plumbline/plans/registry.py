"""A family of registered queries: each a callable (spark, sf_dir) -> DataFrame, with its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

#: Digits to which fractions are compared: sums differ in their last digits with the order of the rows.
DIGITS = 6


class Family:
    def __init__(self):
        self._queries: dict[str, Callable] = {}
        self._sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None, floats: str = "", digits: int = DIGITS) -> Callable:
        """Register a query; the columns named in ``floats`` are rounded on both sides."""
        cols = floats.split()

        def keep(f: Callable) -> Callable:
            def rounded(spark, sf_dir):
                df = f(spark, sf_dir)
                return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols}) if cols else df

            self._queries[name] = rounded
            if sql is not None:
                parts = ", ".join(f'round("{c}", {digits}) + 0.0 as "{c}"' for c in cols)
                self._sql[name] = f"select * replace ({parts}) from ({sql}) rounded_" if cols else sql
            return f

        return keep

    def queries(self) -> dict[str, Callable]:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)
