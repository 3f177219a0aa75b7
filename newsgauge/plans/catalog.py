"""The catalogue of named queries: a Spark plan, and where SQL can say the same, the SQL to check it against."""
from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgauge.plans.domain import Domain, open_domain

DIGITS = 8


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Domain], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]
    digits: int


CATALOG: dict[str, Query] = {}
SQL_VIEWS: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS):
    """Register a plan. `doubles` are the columns compared after rounding, in both engines."""
    def keep(plan: Callable[[Domain], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"{name} registered twice")
        CATALOG[name] = Query(name, plan, sql, tuple(doubles.split()), digits)
        return plan
    return keep


def sql_view(name: str, body: str) -> None:
    """A named step of the checking SQL; names start with x_."""
    SQL_VIEWS[name] = body


def _needed(text: str, seen: list[str]) -> list[str]:
    for word in re.findall(r"\bx_\w+", text):
        if word in SQL_VIEWS and word not in seen:
            _needed(SQL_VIEWS[word], seen)
            if word not in seen:
                seen.append(word)
    return seen


def checking_sql(q: Query) -> str:
    steps = ",\n".join(f"{n} AS (\n{SQL_VIEWS[n].strip()}\n)" for n in _needed(q.sql, []))
    replace = ", ".join(f"round({c}, {q.digits}) AS {c}" for c in q.doubles)
    star = f"* REPLACE ({replace})" if replace else "*"
    return (f"WITH {steps}\n" if steps else "") + f"SELECT {star} FROM (\n{q.sql.strip()}\n) AS answer"


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = q.plan(open_domain(spark, folder))
        for c in q.doubles:
            df = df.withColumn(c, F.round(F.col(c), q.digits))
        return df
    run.__name__ = q.name
    return run
