"""Ranked lexical search over bags: documents that look alike to the items are scored once.

A document is seen through the words of the items only: how often it has each, and its length class m. Documents that
agree in both are one class, found by a hash and told apart by the whole bag. Only classes are scored, against all items, as products of
matrices. A class has a document at least, so an item's first k documents lie in its first k classes; those are expanded by ascending id.
The items' words are taken in blocks where they are many, so no task holds more than a block of them.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.llm.common import numbered_words, raw_texts, slices, trim
from newsgauge.session import cut_point

TOP = 20
BLOCK_WORDS = 20_000       # words of the items of a block: what a task holds of them
CELLS = 4 << 20            # cells of a matrix of classes by words
SCALE, SLOPE, LOW = 1_000_000_000, 25, 75
EXACT = 2 ** 53            # whole numbers below are exact in doubles
# A-Z to a-z; all that is no letter, digit or byte of a character beyond ASCII to a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BAGS = "doc_id long, n long, bag binary"
FOUND = "item long, class_id long, score long, first long"


def item_blocks(items: DataFrame, block_words: int) -> Iterator[pd.DataFrame]:
    """The items' words in blocks: (item, word, times), one block at a time. An item is whole in its block."""
    words = items.select("item", F.explode(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                                                                F.lit(r"[^\x{0}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+"), F.lit(0))).alias("word"))
    counts = cut_point(words.groupBy("item", "word").agg(F.count(F.lit(1)).alias("times")), "item-words")
    size = counts.count()
    blocks = max(1, -(-size // block_words))
    for k in range(blocks if size else 0):
        yield counts.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).toPandas()


def bags(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """(doc_id, n, bag) of documents with words: all its words with repeats, and pairs (number of the item word, times) as a packed array."""
    known = {w: i for i, w in enumerate(words)}

    def run(batches):
        for b in slices(batches):
            codes, lens, distinct = numbered_words([t.translate(FOLD) for t in raw_texts(b)])
            number = np.fromiter((known.get(w, -1) for w in distinct), np.int64, len(distinct))
            word, text = number[codes], np.repeat(np.arange(len(lens)), lens)
            pair, times = np.unique((text * len(known) + word)[word >= 0], return_counts=True)
            flat = np.stack((pair % len(known), times), axis=1).astype(np.uint32)
            ends = np.searchsorted(pair, (np.arange(len(lens)) + 1) * len(known))
            some = np.flatnonzero(lens)
            packed = [flat[ends[i - 1] if i else 0:ends[i]].tobytes() for i in some.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(some)), pa.array(lens[some]), pa.array(packed, pa.binary())], names=["doc_id", "n", "bag"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BAGS)


def document_counts(bags: DataFrame, size: int) -> np.ndarray:
    """In how many documents each item word stands; a task adds up its own."""
    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            flat = np.frombuffer(b"".join(b.column("bag").to_pylist()), np.uint32)
            total += np.bincount(flat[::2], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["word", "df"])
    rows = bags.select("bag").mapInArrow(run, "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).toPandas()   # a row for each word of a block at most
    df = np.zeros(size, np.int64)
    df[rows["word"].to_numpy(np.int64)] = rows["df"]
    return df


def scored(classes: DataFrame, times: np.ndarray, weight: np.ndarray, items: np.ndarray, top: int) -> DataFrame:
    """Each task's best `top` classes of every item: (item, class_id, score, first), score above 0."""
    exact = float(times.sum(axis=1).max(initial=0)) * float(weight.max(initial=0)) * (SCALE // 1000) < EXACT
    table = times.T.astype(np.float64 if exact else np.int64)
    step = max(1, CELLS // max(1, len(weight)))

    def run(batches):
        best: pd.DataFrame | None = None
        for b in batches:
            raw, m = b.column("bag").to_pylist(), b.column("m").to_numpy()
            ids, first = b.column("class_id").to_numpy(), b.column("first").to_numpy(zero_copy_only=False)
            for a in range(0, len(raw), step):
                part = raw[a:a + step]
                size = np.fromiter(map(len, part), np.int64, len(part)) // 8
                flat = np.frombuffer(b"".join(part), np.uint32).astype(np.int64)
                row, word, tf = np.repeat(np.arange(len(part)), size), flat[::2], flat[1::2]
                x = np.zeros((len(part), len(weight)), table.dtype)
                x[row, word] = weight[word] * (SCALE * tf // (1000 * tf + 12 * m[a:a + step][row]))
                score = (x @ table).astype(np.int64)
                found = []
                for k in range(len(items)):
                    s = score[:, k]
                    hit = np.flatnonzero(s > 0)
                    if len(hit) > top:                                       # all that may be among the first, ties included
                        hit = hit[s[hit] >= np.partition(s[hit], -top)[-top]]
                    found.append(pd.DataFrame({"item": items[k], "class_id": ids[a + hit], "score": s[hit], "first": first[a + hit]}))
                best = pd.concat([x for x in (best, *found) if x is not None and len(x)] or found[:1]).sort_values(
                    ["item", "score", "first"], ascending=[True, False, True], na_position="last", kind="stable").groupby("item").head(top)
        if best is not None and len(best):
            yield pa.RecordBatch.from_arrays([pa.array(best[c].to_numpy(), pa.int64(), from_pandas=True) for c in ("item", "class_id", "score", "first")], names=["item", "class_id", "score", "first"])
        trim()
    return classes.select("class_id", "m", "bag", "first").mapInArrow(run, FOUND)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """item_id, rank, doc_id, score: the first `top` documents of each item with a score above 0; equal scores by ascending doc_id.

    Null and empty texts have no words: such documents are in no count and in no result, such items find nothing. Every row of docs is a document,
    also where ids or texts repeat; rows without an id come last among equal scores. Distinct rows (item_id, text) are items. Other columns are ignored.
    """
    spark = docs.sparkSession
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    asked = cut_point(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    parts = []
    for block in item_blocks(asked.select("item", "text"), block_words):
        if not len(block):
            continue
        words, names = sorted(block["word"].unique()), np.sort(block["item"].unique())
        times = np.zeros((len(names), len(words)), np.int64)
        times[np.searchsorted(names, block["item"]), np.searchsorted(np.array(words, object), block["word"].to_numpy(object))] = block["times"]
        seen = cut_point(bags(docs, [w.encode() for w in words]), "bags")
        n_docs, n_terms = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * document_counts(seen, len(words)) + 1))).astype(np.int64)
        classed = seen.filter(F.octet_length("bag") > 0).withColumn("m", LOW + F.expr(f"({SLOPE} * n * {n_docs}L) div {n_terms}L")).withColumn("h", F.xxhash64("m", "bag"))
        classes = classed.groupBy("h", "m", "bag").agg(F.min("doc_id").alias("first"))                # the hash finds, the whole bag decides
        classes = cut_point(classes.withColumn("class_id", F.monotonically_increasing_id()), "classes")
        best = cut_point(scored(classes, times, weight, names, top), "scores")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("first")))
        best = cut_point(best.withColumn("place", place).filter(F.col("place") <= top).drop("place"), "best")
        wanted = cut_point(classes.join(best.select("class_id").distinct(), "class_id", "left_semi").select("class_id", "h", "m", "bag"), "wanted")
        members = classed.select("doc_id", "h", "m", "bag").join(wanted, ["h", "m", "bag"]).select("class_id", "doc_id")
        turn = F.row_number().over(Window.partitionBy("class_id").orderBy(F.asc_nulls_last("doc_id")))
        members = cut_point(members.withColumn("turn", turn).filter(F.col("turn") <= top).drop("turn"), "members")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        parts.append(best.join(members, "class_id").withColumn("rank", rank).filter(F.col("rank") <= top).select("item", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


CHECK_SQL = r"""
WITH f AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS word),
i AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text, up, low), word)) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark), f),
q AS (SELECT item_id, text, term, count(*) AS times FROM i GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, up, low), word) AS terms FROM documents, f WHERE text IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
t AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
c AS (SELECT r, doc_id, any_value(n)::BIGINT AS n, term, count(*) AS tf FROM t GROUP BY r, doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM c, s WHERE term IN (SELECT term FROM q) GROUP BY term),
g AS (SELECT item_id, text, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * c.n * s.n) // s.l))))::BIGINT AS score FROM q JOIN w USING (term) JOIN c USING (term), s GROUP BY item_id, text, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM g WHERE score > 0)
SELECT * FROM k WHERE rank <= 20
"""
