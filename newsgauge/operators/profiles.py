"""Input checks and corpus statistics."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing))
    return df


def survey_profile(raw: DataFrame) -> DataFrame:
    """Rows, blank names, missing percentages and rows per year of a survey table, as (metric, value)."""
    require_columns(raw, ["year", "week", "event", "description", "percentage"])
    per_year = raw.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.trim("event") == "").alias("blank"), F.count_if(F.col("percentage").isNull()).alias("none"))
    total = per_year.agg(F.sum("n").alias("n"), F.sum("blank").alias("b"), F.sum("none").alias("m")).selectExpr(
        "stack(3, 'rows', n, 'blank event names', b, 'missing percentages', m) as (metric, value)")
    return total.unionByName(per_year.select(F.concat(F.lit("rows in "), "year").alias("metric"), F.col("n").alias("value")))


def posts_profile(posts: DataFrame) -> DataFrame:
    """Rows, sources and first and last day of a corpus, as (metric, value)."""
    by = posts.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"), F.min("published_at").alias("a"), F.max("published_at").alias("b"))
    day = "cast(date_format({}, 'yyyyMMdd') as bigint)"
    return by.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("s"), F.min("a").alias("a"), F.max("b").alias("b")).selectExpr(
        f"stack(4, 'posts', n, 'sources', s, 'first day', {day.format('a')}, 'last day', {day.format('b')}) as (metric, value)")


def column_profile(df: DataFrame) -> DataFrame:
    """Filled and missing values and filled share of every column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return counts.selectExpr("_n", f"stack({len(df.columns)}, {pairs}) as (column_name, filled_rows)").select(
        "column_name", "filled_rows", (F.col("_n") - F.col("filled_rows")).alias("missing_rows"),
        F.round(F.col("filled_rows") * 100.0 / F.col("_n"), 2).alias("filled_pct"))


def corpus_stats(posts: DataFrame, period_format: str) -> DataFrame:
    """Rows, sources and rows with text per period."""
    per = posts.groupBy(F.date_format("published_at", period_format).alias("period"), "source_name").agg(
        F.count(F.lit(1)).alias("n"), F.count("summary").alias("s"), F.count_if(F.col("original_message").startswith("plain")).alias("r"))
    return per.groupBy("period").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("sources"), F.sum("s").alias("with_summary"), F.sum("r").alias("with_plain_text"))


def key_conflicts(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """How many keys appear more than once, and for how many of them each column differs (missing is a value)."""
    def differs(c: str):
        first = F.when(F.col(c).isNull(), F.lit("")).otherwise(F.md5(F.col(c).cast("string")))
        return (F.min(first) != F.max(first)).alias(c)
    per_key = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[differs(c) for c in columns]).filter("_n > 1")
    return per_key.agg(F.count(F.lit(1)).alias("duplicate_keys"), *[F.count_if(c).alias(f"differing_{c}") for c in columns])
