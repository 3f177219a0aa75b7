"""Writing results: datasets, manifests, per-event bundles, monthly text and published marts."""
from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_dataset(candidates: DataFrame, kept: DataFrame, folder: str) -> dict[str, str]:
    """The kept posts as CSV and JSON lines, every candidate as CSV."""
    paths = {"kept_csv": f"{folder}/dataset_csv", "kept_jsonl": f"{folder}/dataset_jsonl", "candidates_csv": f"{folder}/candidates_csv"}
    kept.write.csv(paths["kept_csv"], header=True, escape='"')
    kept.write.json(paths["kept_jsonl"])
    candidates.write.csv(paths["candidates_csv"], header=True, escape='"')
    return paths


def write_run(candidates: DataFrame, score: str, cut: float, keyword: str, settings: Mapping[str, str], folder: str) -> dict[str, int]:
    """Write a matching run's candidates, and a manifest of its settings and counts. The counts are taken while the candidates are written, in one pass."""
    kept, word, seen = F.col(score) >= cut, F.col(keyword), Observation()
    counted = candidates.observe(seen, F.count(F.lit(1)).alias("candidates"), F.count_if(kept).alias("kept"), F.count_if(kept & word).alias("kept_keyword"),
                                 F.count_if(kept & ~word).alias("kept_semantic_only"), F.count_if(word).alias("pool"))
    counted.write.parquet(f"{folder}/candidates")
    counts = dict(seen.get)
    pool = counts.pop("pool")
    row = {"params": {**settings, "rerank_threshold": cut}, "counts": {**counts, "keyword_pool_retention": counts["kept_keyword"] / pool if pool else None}}
    candidates.sparkSession.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.text(f"{folder}/manifest")
    return counts


def detail_bundles(events: DataFrame, parts: Mapping[str, DataFrame]) -> DataFrame:
    """One nested row per event with every part's rows of it; a part naming an unknown event stops the run.

    Parts are per-event short lists (groups, days of the window, first posts, first terms), not posts as such.
    """
    out = events.withColumn("_known", F.lit(True))
    for name, part in parts.items():
        inner = [c for c in part.columns if c != "event_id"]
        listed = part.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct(*inner))).alias(name))
        out = out.join(listed, "event_id", "full")
    known = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown event "), "event_id")).cast("boolean")).otherwise(F.col("_known"))
    return out.withColumn("_known", known).filter("_known").drop("_known")


def write_partitioned(df: DataFrame, path: str, by: str, fmt: str = "json") -> str:
    """One folder per value; rows of one value are brought together first, so files stay few, and a large value is split over tasks."""
    df.hint("rebalance", by).write.partitionBy(by).format(fmt).save(path)
    return path


COMMITS = "mart string, path string, rows long, seq int"


def commits(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(COMMITS).json(f"{folder}/commits")


def _last(spark: SparkSession, folder: str) -> int:
    try:
        return commits(spark, folder).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    except AnalysisException as e:                                           # nothing was published here yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def publish(marts: Mapping[str, DataFrame], allowed: Sequence[str], folder: str) -> int:
    """Publish the allowed marts together and return the number of the set. A missing mart stops the run before anything is written.

    Marts are written to a folder of their own, each counted while it is written. One small file then names the set; until it is there, readers
    have the set before, and a mart that fails leaves that as it was.
    """
    missing = [name for name in allowed if name not in marts]
    if missing:
        raise RuntimeError("marts asked for but not given: " + ", ".join(missing))
    staged, spark, rows = f"{folder}/sets/{uuid.uuid4().hex[:12]}", None, []
    for name in allowed:
        seen, spark = Observation(), marts[name].sparkSession
        marts[name].observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{staged}/{name}")
        rows.append(json.dumps({"mart": name, "path": f"{staged}/{name}", "rows": seen.get["rows"]}))
    seq = _last(spark, folder) + 1
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(f"{folder}/commits/seq={seq}")
    return seq


def published_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(mart, rows) of the set that readers have now."""
    return commits(spark, folder).filter(F.col("seq") == _last(spark, folder)).select("mart", "rows")


def read_published(spark: SparkSession, folder: str, mart: str) -> DataFrame:
    """A mart of the set published last."""
    path = commits(spark, folder).filter((F.col("seq") == _last(spark, folder)) & (F.col("mart") == mart)).first()
    if path is None:
        raise LookupError(f"no mart {mart} in the last set")
    return spark.read.parquet(path.path)
