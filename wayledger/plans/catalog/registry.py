"""Named queries over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ...functions.pseudonym import PlateHasher
from .. import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *uses: str, sql: str | None = None, recursive: bool = False):
    """Register a plan; ``sql`` may refer to the adapters named in ``uses``."""

    def wrap(plan: Callable[[A.Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plan(A.Tables(spark, sf_dir))
        if sql is not None:
            head = A.ctes(*uses) if uses else ""
            ORACLES[name] = (head.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else head) + sql
        return plan

    return wrap


def hmac_sql(text: str) -> str:
    """HMAC-SHA256 of a text expression under the test key, spelled out in SQL."""
    h = PlateHasher(A.TEST_KEY)
    return (
        f"sha256(unhex('{h._outer.hex()}') || unhex(sha256(unhex('{h._inner.hex()}') || encode({text}))))"
    )


def values_sql(rows, *names: str) -> str:
    """A constant table in SQL."""
    def lit(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v) + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS t({', '.join(names)})"
