"""A corpus pipeline of five stages over `documents`: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage reads all that the one before kept, and is written as Parquet before the next one starts. All but the last
return the columns of documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgauge.llm.common import table
from newsgauge.session import cut_point


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees."""
    from newsgauge.llm.quality_rules import kept_documents
    return kept_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts rid of chunks and stretches of lines that occurred before; n_chars is counted anew. A document of which nothing but white space is left goes."""
    from newsgauge.llm.line_dedup import without_repeats
    cut = without_repeats(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    counted = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.filter(left).withColumn("n_chars", counted).select(docs.columns)


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the rows that `found` names by doc_id and text_id (a hash of the text): an id may stand for several texts."""
    found = cut_point(found.select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text")).distinct(), "gone")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text")), "left_anti").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    from newsgauge.llm.near_dups import near_groups
    return without(docs, near_groups(docs).filter(~F.col("kept")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    from newsgauge.llm.decontaminate import leaks
    return without(docs, leaks(docs, table(spark, sf_dir, "benchmark")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether they decode to it."""
    import public_tokenizers

    from newsgauge.llm.pieces import encoded
    return encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]
# The trees of the first stage are fitted and the last one encodes, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_point(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
