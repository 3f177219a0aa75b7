"""Parameterised SQL: named values bound by Spark, optional pieces left out when their value is empty."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def run_sql(spark: SparkSession, template: str, frames: dict[str, DataFrame], values: dict[str, object]) -> DataFrame:
    """Run SQL over DataFrames. A piece in [[…]] stands only if every :name in it has a value."""
    def optional(match: re.Match) -> str:
        names = re.findall(r":(\w+)", match.group(1))
        return match.group(1) if all(values.get(n) not in (None, "") for n in names) else ""
    text = re.sub(r"\[\[(.*?)\]\]", optional, template, flags=re.S)
    used = {n: v for n, v in values.items() if re.search(rf":{n}\b", text)}
    return spark.sql(text, args=used, **frames)
