"""Registration of queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.fixtures import with_views


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTERED: dict[str, Query] = {}


def query(name: str, sql: str | None = None, doubles: Sequence[str] = (), digits: int = 6):
    """Register a query. ``doubles`` are rounded on both sides, since sums run in different orders.

    Adding zero turns a negative zero into a positive one.
    """

    def decorate(function: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTERED:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            result = function(spark, sf_dir)
            return result.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in doubles}) if doubles else result

        checked = None
        if sql is not None:
            replaced = ", ".join(f"round({c}, {digits}) + 0e0 as {c}" for c in doubles)
            checked = with_views(f"select *{f' replace ({replaced})' if doubles else ''} from (\n{sql.strip()}\n) q")
        REGISTERED[name] = Query(name, run, checked)
        return function

    return decorate
