"""Session settings and the shared folder for tables that outlive one plan."""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "newsgauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; a cluster supplies its own master and memory."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "10000")    # rankings with k up to this are cut to k rows per key before the shuffle
    )
    if master:
        b = b.master(master)
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    On one machine that names none (tests) a temporary folder is made and set; a cluster has to name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="newsgauge-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; no two runs ever write to the same one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files behind. Otherwise they stay until the driver collects its garbage, however many cuts follow."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def cut_point(df: DataFrame, name: str) -> DataFrame:
    """Write a table that many later plans read to the shared folder and read it back.

    Cuts the lineage on reliable storage, so a lost executor never recomputes past this point. Digests and
    words fill most of these tables; zstd takes about two thirds of the default's space.
    """
    path = run_dir(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def summary(df: DataFrame) -> DataFrame:
    """Per-key figures about to be joined back to their rows, written first so that their true size is known.

    Spark estimates an aggregate as large as its input and would shuffle the rows, a hot key in one
    partition. A written summary is sent to every task where it is below the broadcast threshold, and
    joined by shuffle, with skew splitting, where it is not.
    """
    return cut_point(df, "summary")
