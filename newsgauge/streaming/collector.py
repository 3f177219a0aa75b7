"""Following a folder of newly collected posts: only newer posts, each once, safe to replay."""
from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.session import run_dir
from newsgauge.sources.store import PostStore


def follow_posts(store: PostStore, arriving: str, checkpoint: str | None = None):
    """Start a stream that appends what `store` lacks and stops when the folder is read through.

    A batch goes into a folder of its own, named after the stream's checkpoint and the batch's number. A batch that died half-way overwrites what it
    left when it runs again, and one that was committed before the stream noted it adds nothing.
    """
    checkpoint = checkpoint or run_dir(store.spark, "collector")
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        store.append(batch, f"{name}-{number}")
    stream = store.spark.readStream.schema(store.schema).parquet(arriving)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_coverage(posts: DataFrame, at: str, ident: list[str], group: str, late: str = "2 days") -> DataFrame:
    """Posts and reach of each group and day of a stream, each post once.

    Days are event-time windows under a watermark: a post later than `late` behind the newest one seen is left out, and so is a copy of a post that
    comes within that time. In append mode a day is given out once, when the watermark has passed its end; what is kept meanwhile is bounded by `late`.
    """
    once = posts.withWatermark(at, late).dropDuplicatesWithinWatermark(ident)
    days = once.groupBy(F.window(at, "1 day").alias("day"), group)
    return days.agg(F.count(F.lit(1)).alias("posts"), F.sum("views").alias("views")).select(F.to_date("day.start").alias("day"), group, "posts", "views")
