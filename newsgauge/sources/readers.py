"""Reading raw inputs: typed CSV stacks, nested manifests, record files, group maps and corpora."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgauge.operators.framing import RECORD

# Columns of a matched-post file with the type each is read as; a column empty throughout keeps its type.
MATCH_COLUMNS = {
    "source_name": "string", "message_id": "bigint", "published_at": "timestamp", "is_digest": "bigint", "summary": "string",
    "original_message": "string", "views": "bigint", "forwards": "double", "cosine_max": "double", "rerank_score": "double", "keyword_match": "boolean"}

MANIFEST = (
    "generated_at string, event struct<event_id:string,slug:string,name:string,year:int,week:int,percentage:string,quotes:array<string>>, "
    "window struct<match_start:date,match_end_exclusive:date>, models struct<retriever:string,embed_model:string,rerank_model:string>, "
    "params struct<top_k:int,rerank_threshold:double>, counts struct<candidates:bigint,kept:bigint,embedded_pool:bigint>")


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, column types found by Spark."""
    return spark.read.csv(path, header=True, inferSchema=True, escape='"', multiLine=False)


def read_match_stack(spark: SparkSession, layouts: Sequence[str], columns: Mapping[str, str] = MATCH_COLUMNS, kept: Sequence[str] = ()) -> DataFrame:
    """Many match files as one table: columns pinned to fixed types, unreadable values NULL, missing columns NULL.

    `layouts` are folders whose files share a header; each is one scan of all its files. `kept` names
    partition columns (the event's slug, year, week) that come from the folder names.
    """
    out = None
    for path in layouts:
        raw = spark.read.csv(path, header=True, escape='"')
        have = [F.col(c).try_cast(t).alias(c) for c, t in columns.items() if c in raw.columns]
        part = raw.select(*kept, *have)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_manifests(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=multi_line)


def manifest_rows(manifests: DataFrame, default_retriever: str = "summary") -> DataFrame:
    """One provenance row per manifest; a manifest without a retriever was built by the default one."""
    return manifests.select(
        "event.event_id", F.col("event.slug").alias("event_slug"), F.col("event.name").alias("event_name"), F.col("event.year").alias("survey_year"),
        F.col("event.week").alias("survey_week"), F.col("event.percentage").alias("attention_text"),
        F.coalesce(F.to_json("event.quotes"), F.lit("[]")).alias("quotes"), F.col("generated_at").alias("built_at"), "window.match_start",
        "window.match_end_exclusive", F.coalesce("models.retriever", F.lit(default_retriever)).alias("retriever"), "models.embed_model",
        "models.rerank_model", "params.top_k", "params.rerank_threshold", F.col("counts.candidates").alias("candidates"),
        F.col("counts.kept").alias("kept"), F.col("counts.embedded_pool").alias("embedded_pool"))


def empty_searches(manifests: DataFrame) -> DataFrame:
    """Searches that kept nothing; a manifest that kept posts stops the load."""
    kept = F.coalesce("counts.kept", F.lit(0))
    message = F.concat(F.col("event.slug"), F.lit(" kept "), kept, F.lit(" posts; load it as a dataset instead"))
    checked = F.when(kept > 0, F.raise_error(message).cast("bigint")).otherwise(kept)
    return manifests.select(
        F.col("event.event_id").alias("event_id"), F.col("event.slug").alias("event_slug"), F.col("event.name").alias("event_name"),
        F.col("event.year").alias("survey_year"), F.col("event.week").alias("survey_week"), "models.retriever", "params.rerank_threshold",
        F.col("counts.candidates").alias("candidates"), checked.alias("kept"))


def group_map(config: DataFrame) -> DataFrame:
    """(group_key, label, sources array) to one row per source; a group without a label shows its key."""
    return config.select("group_key", F.coalesce("label", "group_key").alias("media_group"), F.explode("sources").alias("source_name")).select(
        "source_name", F.col("group_key").alias("media_group_key"), "media_group", F.lit(True).alias("is_grouped"))


def archived_sources(config: DataFrame) -> DataFrame:
    """(by_reason map of arrays) to one row per excluded source with its reason."""
    return config.select(F.explode("by_reason").alias("reason", "sources")).select(F.explode("sources").alias("source_name"), "reason")


def corpus_union(archive: DataFrame, newer: DataFrame) -> DataFrame:
    """The archive and the newer text posts it lacks; ids are compared as text."""
    key = ["source_name", "message_id"]
    a = archive.withColumn("message_id", F.col("message_id").cast("string"))
    b = newer.filter(F.col("record_type") == "text").withColumn("message_id", F.col("message_id").cast("string"))
    missing = b.join(a.select(*key), key, "left_anti")
    columns = [c for c in a.columns if c in b.columns]
    return a.select(*columns).unionByName(missing.select(*columns))


def read_done_ids(lines: DataFrame, column: str = "value", field: str = "message_id") -> DataFrame:
    """Ids out of result lines; a broken or incomplete line gives none."""
    ident = F.get_json_object(column, f"$.{field}")
    return lines.select(ident.alias(field)).filter(F.col(field).isNotNull()).distinct()


def pending(rows: DataFrame, done: DataFrame, ident: str = "message_id") -> DataFrame:
    """Rows not processed yet; ids are compared as text."""
    return rows.withColumn("_id", F.col(ident).cast("string")).join(done.select(F.col(ident).alias("_id")), "_id", "left_anti").drop("_id")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Framing records from JSON lines under an explicit schema; a missing on_event counts as true."""
    return spark.read.schema(RECORD).json(path).filter(F.coalesce("on_event", F.lit(True)))


def manifest_struct(slug: Column, name: Column, year: Column, week: Column, event_id: Column, percentage: Column, quotes: Column, start: Column, end: Column,
                    built: Column, models: Column, params: Column, counts: Column) -> list[Column]:
    """The columns of a manifest, for writing one."""
    return [built.cast("string").alias("generated_at"),
            F.struct(event_id.alias("event_id"), slug.alias("slug"), name.alias("name"), year.alias("year"), week.alias("week"),
                     percentage.cast("string").alias("percentage"), quotes.alias("quotes")).alias("event"),
            F.struct(start.alias("match_start"), end.alias("match_end_exclusive")).alias("window"), models.alias("models"), params.alias("params"), counts.alias("counts")]
