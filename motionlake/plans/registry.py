"""Registration of queries. Doubles are rounded to 6 digits on both sides, since sums depend on their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register a function of (spark, sf_dir). doubles: names of the double columns of the SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*(rounded(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            parts = ", ".join(f"round({c}, {digits}) + 0.0::DOUBLE AS {c}" for c in doubles.split())
            ORACLES[name] = f"SELECT * REPLACE ({parts}) FROM ({sql}) AS result" if parts else sql
        return f

    return add
