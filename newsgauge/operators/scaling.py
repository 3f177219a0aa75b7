"""Exact ranks, medians and chunked lists that never put one whole key into one task.

A key (an event, a source, a media group) may hold a third of all rows. A plain window over such a
key sorts it in a single task, and percentile() holds its distinct values in one buffer. Here the
order is cut into blocks that follow it, blocks are counted, and only a block is ever sorted alone.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.session import summary

TIE_BITS = 20          # rows that share one score are cut by id into blocks of at most 2^20 ids
VALUE_BLOCKS = 1024    # equal-width blocks of a score range


def score_block(score: Column, lo: float, hi: float, blocks: int = VALUE_BLOCKS, descending: bool = True) -> Column:
    """The block of a score; block numbers grow in the direction of the order."""
    share = (F.lit(hi) - score) if descending else (score - F.lit(lo))
    part = F.floor(share / F.lit(float(hi - lo)) * F.lit(blocks))
    held = F.least(F.greatest(part, F.lit(0)), F.lit(blocks))
    return F.when(part.isNull(), blocks + 1).otherwise(held).cast("int")      # NULL scores come last


def magnitude_block(value: Column, per_octave: int = 64) -> Column:
    """A block for numbers of unknown range: 64 blocks per doubling, growing with the value."""
    step = F.floor(F.log2(F.abs(value.cast("double")) + F.lit(1.0)) * F.lit(per_octave))
    return F.when(value < 0, -step - 1).otherwise(step).cast("int")


def rank_in_blocks(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], out: str) -> DataFrame:
    """row_number() over keys by `order`, when `block` never decreases along that order."""
    keys = list(keys)
    d = df.withColumn("_block", block)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        d.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        d.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, keys + ["_block"])
        .withColumn(out, (F.col("_before") + F.col("_rn")).cast("long"))
        .drop("_block", "_rn", "_before")
    )


def rank_by_score(
    df: DataFrame, keys: Sequence[str], score: str, tie: str, lo: float, hi: float,
    out: str = "rank", descending: bool = True, blocks: int = VALUE_BLOCKS,
) -> DataFrame:
    """Exact rank over keys by score, ties by id.

    Three steps: score blocks over the key, (score, id block) pairs inside a score block, rows inside
    a pair. Rows sharing one hot score are spread by id; distinct scores are spread by block.
    """
    keys = list(keys)
    # Missing scores come last; a stand-in value keeps the join below a plain equality, so it uses the window's shuffle.
    stand_in = F.coalesce(F.col(score).cast("double"), F.lit(float("-inf") if descending else float("inf")))
    d = (
        df.withColumn("_sb", score_block(F.col(score), lo, hi, blocks, descending)).withColumn("_s", stand_in)
        .withColumn("_tb", F.shiftright(F.col(tie).cast("long"), TIE_BITS)))
    by_score = F.col("_s").desc() if descending else F.col("_s").asc()
    pairs = d.groupBy(*keys, "_sb", "_s", "_tb").agg(F.count(F.lit(1)).alias("_n"))
    top = pairs.groupBy(*keys, "_sb").agg(F.sum("_n").alias("_bn"))
    prior = Window.partitionBy(*keys).orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1)
    top = top.select(*keys, "_sb", F.coalesce(F.sum("_bn").over(prior), F.lit(0)).alias("_b0"))
    prior = Window.partitionBy(*keys, "_sb").orderBy(by_score, "_tb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pairs.withColumn("_p0", F.coalesce(F.sum("_n").over(prior), F.lit(0)))
        .join(top, keys + ["_sb"]).select(*keys, "_s", "_tb", (F.col("_b0") + F.col("_p0")).alias("_before")))
    inside = Window.partitionBy(*keys, "_s", "_tb").orderBy(tie)
    return (
        d.withColumn("_rn", F.row_number().over(inside)).join(offsets, keys + ["_s", "_tb"])
        .withColumn(out, (F.col("_before") + F.col("_rn")).cast("long"))
        .select(*df.columns, out)
    )


def rank_by_digest(df: DataFrame, keys: Sequence[str], digest: str, out: str = "rank") -> DataFrame:
    """Rank by a hex digest column (a seeded permutation): the first four hex digits are even blocks."""
    return rank_in_blocks(df, keys, F.substring(digest, 1, 4), [F.col(digest)], out)


def rank_by_id(df: DataFrame, keys: Sequence[str], ident: str, out: str = "rank", bits: int = TIE_BITS) -> DataFrame:
    """Rank by a whole-number id."""
    return rank_in_blocks(df, keys, F.shiftright(F.col(ident).cast("long"), bits), [F.col(ident)], out)


def percent_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """percent_rank() over all rows by a number, NULLs last and equal values alike, without sorting all rows in one task.

    Values are counted, the counts of blocks of values added up, and values sorted inside a block only.
    """
    block = F.coalesce(magnitude_block(F.col(value)), F.lit(2 ** 31 - 1))
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", block)
    prior = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)                      # one row for each block: 64 a doubling
    offsets = counts.groupBy("_block").agg(F.sum("_n").alias("_bn")).select(
        "_block", F.coalesce(F.sum("_bn").over(prior), F.lit(0)).alias("_before"), F.sum("_bn").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_block").orderBy(F.col(value).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    share = (F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).cast("double") / F.greatest(F.col("_all") - 1, F.lit(1))
    ranks = summary(counts.join(offsets, "_block").select(F.col(value).alias("_v"), share.alias(out)))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def running_sum(
    df: DataFrame, position: str, value: str, out: str, keys: Sequence[str] = (), bits: int = 14
) -> DataFrame:
    """Running total along a dense position (1, 2, 3 …): totals of position blocks, then inside a block."""
    keys = list(keys)
    d = df.withColumn("_block", F.shiftright(F.col(position).cast("long"), bits))
    prior = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        d.groupBy(*keys, "_block").agg(F.sum(value).alias("_t"))
        .select(*keys, "_block", F.coalesce(F.sum("_t").over(prior), F.lit(0)).alias("_before"))
    )
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        d.withColumn("_run", F.sum(value).over(inside)).join(offsets, keys + ["_block"])
        .withColumn(out, F.col("_before") + F.col("_run")).drop("_block", "_run", "_before")
    )


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """The interpolated median per key, from value counts and block totals instead of one buffer per key."""
    keys = list(keys)
    counts = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_block", magnitude_block(F.col(value)))
    )
    whole = Window.partitionBy(*keys)
    prior = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    middle = (
        counts.groupBy(*keys, "_block").agg(F.sum("_n").alias("_bn"))
        .withColumn("_total", F.sum("_bn").over(whole))
        .withColumn("_before", F.coalesce(F.sum("_bn").over(prior), F.lit(0)))
        .withColumn("_lo", F.expr("(_total + 1) div 2")).withColumn("_hi", F.expr("(_total + 2) div 2"))
        .filter((F.col("_before") < F.col("_hi")) & (F.col("_before") + F.col("_bn") >= F.col("_lo")))
        .drop("_bn", "_total")
    )
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = counts.join(middle, keys + ["_block"]).withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
    start = F.col("_end") - F.col("_n")

    def at(position: str) -> Column:
        return F.max(F.when((start < F.col(position)) & (F.col("_end") >= F.col(position)), F.col(value).cast("double")))

    return placed.groupBy(*keys).agg(((at("_lo") + at("_hi")) / 2).alias(out))


def chunked_list(df: DataFrame, keys: Sequence[str], item: str, out: str, chunk: int = 10_000) -> DataFrame:
    """Lists of items per key, cut into parts of about `chunk` items; together the parts hold every item.

    A key with few items gets one part (part 0), the plain list. A key with a hundred million items
    gets ten thousand rows instead of one array that no task could hold.
    """
    keys = list(keys)
    # Only keys that need several parts are looked up, so that items are shuffled once, with their list.
    parts = summary(df.groupBy(*keys).agg(F.ceil(F.count(item) / F.lit(chunk)).cast("long").alias("_parts")).filter("_parts > 1"))
    return (
        df.join(parts, keys, "left")
        .withColumn("part", F.pmod(F.xxhash64(item), F.coalesce("_parts", F.lit(1))))
        .groupBy(*keys, "part").agg(F.sort_array(F.collect_list(item)).alias(out))
    )
