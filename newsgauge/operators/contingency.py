"""Contingency statistics over one long table of counts: chi-square, Cramér's V, Holm, leaderboards."""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.session import summary

DIM = ["event", "dimension"]


def upper_tail(chi2: str, dof: str) -> Column:
    """P(X >= chi2) for a chi-square variable with whole degrees of freedom, by its closed form."""
    def tail(x: float, k: int) -> float:
        if x <= 0:
            return 1.0
        h, term = x / 2.0, 0.0
        if k % 2 == 0:
            p, term = math.exp(-h), math.exp(-h)
            for i in range(1, k // 2):
                term *= h / i
                p += term
            return min(p, 1.0)
        p = math.erfc(math.sqrt(h))
        if k > 1:
            term = math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
            p += term
            for i in range(2, (k - 1) // 2 + 1):
                term *= h / (i - 0.5)
                p += term
        return min(p, 1.0)

    @F.pandas_udf("double")
    def f(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([tail(float(a), int(b)) for a, b in zip(x, k)], dtype="float64")

    return f(F.col(chi2).cast("double"), F.col(dof).cast("int"))


def chi_square(counts: DataFrame) -> DataFrame:
    """Chi-square of category × group per event and dimension; empty rows and columns are gone, 2×2 tables corrected.

    Every cell of the table counts, also the empty ones, so cells come from the two margins.
    """
    cells = summary(counts.filter("n > 0").groupBy(*DIM, "category", "media_group").agg(F.sum("n").alias("n")))     # read by both margins, the shape and the grid
    rows = cells.groupBy(*DIM, "category").agg(F.sum("n").alias("r"))
    cols = cells.groupBy(*DIM, "media_group").agg(F.sum("n").alias("c"))
    shape = rows.groupBy(*DIM).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("r").alias("total")).join(
        cols.groupBy(*DIM).agg(F.count(F.lit(1)).alias("n_cols")), DIM).filter("n_rows > 1 and n_cols > 1")
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    grid = rows.join(shape, DIM).join(cols, DIM).join(cells, [*DIM, "category", "media_group"], "left")
    grid = grid.withColumn("o", F.coalesce("n", F.lit(0)).cast("double")).withColumn("e", F.col("r").cast("double") * F.col("c") / F.col("total"))
    off = F.abs(F.col("o") - F.col("e"))
    off = F.when(dof == 1, off - F.least(F.lit(0.5), off)).otherwise(off)
    stat = grid.groupBy(*DIM, "n_rows", "n_cols", "total").agg(
        F.sum(off * off / F.col("e")).alias("chi2"), F.min("e").alias("min_expected"), F.avg((F.col("e") < 5).cast("int")).alias("share_below_5"))
    v = F.sqrt(F.col("chi2") / (F.col("total") * (F.least("n_rows", "n_cols") - 1)))
    return stat.select(*DIM, F.col("total").alias("n"), "chi2", dof.alias("dof"), v.alias("v"), "min_expected", "share_below_5")


def with_p(stat: DataFrame) -> DataFrame:
    return stat.withColumn("p", upper_tail("chi2", "dof"))


def holm(tests: DataFrame) -> DataFrame:
    """Holm's step-down adjusted p per event (a few dozen tests each)."""
    w = Window.partitionBy("event").orderBy("p", "dimension")
    m = F.count(F.lit(1)).over(Window.partitionBy("event"))
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col("p"))
    return tests.withColumn("_a", step).withColumn("p_holm", F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_a")


def leaderboard(tests: DataFrame) -> DataFrame:
    """Dimensions by strength of association, with stars for the adjusted p and a flag for thin tables."""
    p = F.col("p_holm")
    place = F.row_number().over(Window.partitionBy("event").orderBy(F.desc(F.round("v", 12)), "dimension"))
    stars = F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
    return holm(tests).withColumn("place", place.cast("long")).withColumn("stars", stars).withColumn("thin", F.col("share_below_5") > 0.2)
