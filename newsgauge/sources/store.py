"""A store of posts that only grows: a folder for each batch, and a small table of marks that commits it.

    posts/batch=<name>/month=<date>/…   the posts of a batch
    marks/seq=<n>/…                     after commit n: the newest time and the largest id of every source, and which batch it was

A batch counts once its marks are written, which is one file. What a writer left half-way is in a folder that no reader
looks into, and is overwritten when the batch runs again; a batch that is committed never runs again. One writer at a time.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class PostStore:
    def __init__(self, spark: SparkSession, folder: str, schema: str, source: str, at: str, ident: str):
        self.spark, self.folder, self.source, self.at, self.ident = spark, folder.rstrip("/"), source, at, ident
        self.schema = spark.createDataFrame([], schema).schema
        kinds = dict(spark.createDataFrame([], self.schema).dtypes)
        self.mark_schema = f"source {kinds[source]}, newest {kinds[at]}, largest {kinds[ident]}, batch string"

    @property
    def key(self) -> list[str]:
        return [self.source, self.ident]

    def create(self) -> PostStore:
        """An empty store."""
        self._commit(0, self.spark.createDataFrame([], self.mark_schema), "")
        return self

    def _commit(self, seq: int, marks: DataFrame, batch: str) -> None:
        note = self.spark.createDataFrame([(None, None, None, batch)], self.mark_schema)
        rows = marks.select("source", "newest", "largest", F.lit(None).cast("string").alias("batch")).unionByName(note)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/marks/seq={seq}")

    def marks(self) -> DataFrame:
        return self.spark.read.schema(self.mark_schema + ", seq int").parquet(f"{self.folder}/marks")

    def committed(self) -> tuple[int, set[str]]:
        """(number of the last commit, batches committed): a row for each batch, none for posts."""
        rows = self.marks().filter("batch is not null").select("seq", "batch").collect()
        return max(r.seq for r in rows), {r.batch for r in rows if r.batch}

    def newest(self, seq: int | None = None) -> DataFrame:
        """(source, newest, largest) as of a commit; other commits' files are not read."""
        last = self.committed()[0] if seq is None else seq
        return self.marks().filter((F.col("seq") == last) & F.col("batch").isNull()).select("source", "newest", "largest")

    def posts(self, where: Column | None = None) -> DataFrame:
        """The posts of committed batches, with `batch` and `month` (its first day); folders outside `where` and of other batches are not read."""
        _, batches = self.committed()
        if not batches:
            return self.spark.createDataFrame([], self.schema).withColumns({"batch": F.lit(""), "month": F.lit(None).cast("date")})
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        kept = self.spark.read.schema(f"{fields}, batch string, month date").parquet(f"{self.folder}/posts").filter(F.col("batch").isin(sorted(batches)))
        return kept if where is None else kept.filter(where)

    def fresh(self, arriving: DataFrame, seq: int) -> DataFrame:
        """What arrives past its source's newest stored post, each key once, the earliest of it, and none already stored.

        `largest` is the largest stored id of the source: an id above it is new as it stands.
        """
        a = arriving.select(*self.schema.names).join(self.newest(seq).withColumnRenamed("source", self.source), self.source, "left")
        a = a.filter(F.col("newest").isNull() | (F.col(self.at) > F.col("newest")))
        first = F.row_number().over(Window.partitionBy(*self.key).orderBy(self.at))
        return a.withColumn("_rn", first).filter(F.col("_rn") == 1).drop("_rn")

    def append(self, arriving: DataFrame, batch: str) -> bool:
        """Add a batch; False if it was committed before. Runs again after a failure with the same result."""
        seq, done = self.committed()
        if batch in done:
            return False
        path = f"{self.folder}/posts/batch={batch}"
        fresh = self.fresh(arriving, seq)
        new = fresh.filter(F.col("largest").isNull() | (F.col("largest") < F.col(self.ident))).select(*self.schema.names)
        low = fresh.filter(F.col("largest") >= F.col(self.ident)).select(*self.schema.names)
        if not low.isEmpty():                                                # posts that came again under a later date, or ids out of order: looked up
            new = new.unionByName(low.join(self.posts().select(*self.key), self.key, "left_anti"))
        new.withColumn("month", F.trunc(self.at, "month")).hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(path)
        seen = arriving.groupBy(F.col(self.source).alias("source")).agg(F.max(self.at).alias("newest"), F.max(self.ident).alias("largest"))
        marks = self.newest(seq).unionByName(seen).groupBy("source").agg(F.max("newest").alias("newest"), F.max("largest").alias("largest"))
        self._commit(seq + 1, marks, batch)
        return True
