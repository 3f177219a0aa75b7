"""Finding candidate posts: window scans, keyword search, vector similarity and candidate lists."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.operators.scaling import rank_by_score
from newsgauge.session import cut_point, summary


def keyword_search(posts: DataFrame, start: str, end_exclusive: str, terms: Mapping[str, Sequence[str]], limit: int) -> DataFrame:
    """Browse candidates: posts of a window with any of the terms in the named columns, earliest first."""
    hit = F.lit(False)
    for column, words in terms.items():
        for w in words:
            hit = hit | F.coalesce(F.lower(F.col(column)).like(f"%{w.lower()}%"), F.lit(False))
    window = (F.col("published_date") >= F.lit(start).cast("date")) & (F.col("published_date") < F.lit(end_exclusive).cast("date"))
    return posts.filter(window & hit).orderBy("published_at", "source_name", "message_id", "topic").limit(limit)


def window_scan(posts: DataFrame, start: str, end_exclusive: str, date: str, vector: str) -> DataFrame:
    """Posts of a half-open window whose date and vector are usable."""
    at = F.try_to_timestamp(F.col(date))
    return posts.filter((at >= F.lit(start).cast("timestamp")) & (at < F.lit(end_exclusive).cast("timestamp")) & (F.size(vector) > 0)).withColumn("at", at)


def unit(vector: str):
    """A vector over its length (at least 1e-12)."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return F.transform(v, lambda x: x / norm)


def _best_probes(matrix: np.ndarray, mine: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(score, probe) of the best of an event's probes for each vector; mine is sorted by probe, so ties go to the smaller one.

    Cosines are taken to 12 digits: the order of equal ones must not hang on the order of a sum.
    """
    s = np.round(matrix @ np.stack(mine["probe_vector"].to_numpy()).T, 12)
    top = s.argmax(axis=1)
    return s[np.arange(len(s)), top], mine["probe"].to_numpy()[top]


def _first(score: np.ndarray, ident: np.ndarray, top_k: int) -> np.ndarray:
    """Places of the first K by score, ties by id: a bounded heap of one block."""
    at = np.arange(len(score)) if len(score) <= top_k else np.flatnonzero(score >= np.partition(score, -top_k)[-top_k])
    return at[np.lexsort((ident[at], -score[at]))[:top_k]]


def _met(vectors: DataFrame, probes: DataFrame, window: str, ident: str, vector: str, rows_per_block: int, probes_per_block: int):
    """Blocks of vectors and blocks of probes of one window, cogrouped: each block of one side meets each of the other once.

    An event's probes stay together, unless they alone are more than a block; `_parts` tells in how many they are.
    """
    count = lambda rows, keys, per, name: rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias(name))
    grid = summary(count(vectors, [window], rows_per_block, "_nv").join(count(probes, [window], probes_per_block, "_np"), window))
    parts = summary(count(probes, ["event_id"], probes_per_block, "_parts"))
    block = lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = vectors.join(grid, window).select(
        F.col(window).alias("_w"), F.col(ident).alias("_id"), F.col(vector).alias("_v"), block("_nv", ident).alias("_b"), every("_np").alias("_p"))
    part = F.when(F.col("_parts") > 1, block("_parts", "probe")).otherwise(0)
    asked = probes.join(grid, window).join(parts, "event_id").withColumn("_part", part).select(
        F.col(window).alias("_pw"), every("_nv").alias("_pb"), block("_np", "event_id", "_part").alias("_pp"), "event_id", "probe", "probe_vector", "_parts")
    return dealt.groupBy("_w", "_b", "_p").cogroup(asked.groupBy("_pw", "_pb", "_pp")), dict(asked.dtypes) | dict(dealt.dtypes)


def probe_scores(vectors: DataFrame, probes: DataFrame, window: str, ident: str, vector: str, top_k: int | None = None, floor: float | None = None,
                 rows_per_block: int = 4096, probes_per_block: int = 256) -> DataFrame:
    """The best probe of every event for every id of the event's window, as (event_id, id, score, probe); ties go to the smaller probe.

    Vectors and probes must be unit length. An id with several vectors (a post's fragments) has the score of its best one, found
    inside its block. Below `floor` nothing leaves a block, and with `top_k` no more than K ids of an event do: an id among the first K is among
    the first K of the block that holds its best probe, and what else leaves a block with a lower score ranks behind K others.
    """
    met, kinds = _met(vectors, probes, window, ident, vector, rows_per_block, probes_per_block)
    schema = f"event_id {kinds['event_id']}, id {kinds['_id']}, score double, probe {kinds['probe']}"

    def best(rows: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"event_id": [], "id": [], "score": [], "probe": []})]
        if len(rows) and len(mine):
            order = np.argsort(rows["_id"].to_numpy(), kind="stable")
            ids, matrix = rows["_id"].to_numpy()[order], np.stack(rows["_v"].to_numpy()[order])
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            for event, group in mine.sort_values("probe").groupby("event_id"):
                score, probe = _best_probes(matrix, group)
                if len(first) < len(ids):                                    # the best vector of each id
                    own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
                    at = np.lexsort((probe, -score, own))[first]
                    score, probe = score[at], probe[at]
                mine_ids = ids[first]
                if floor is not None:
                    high = score >= floor
                    score, probe, mine_ids = score[high], probe[high], mine_ids[high]
                if top_k is not None:
                    at = _first(score, mine_ids, top_k)
                    score, probe, mine_ids = score[at], probe[at], mine_ids[at]
                out.append(pd.DataFrame({"event_id": event, "id": mine_ids, "score": score, "probe": probe}))
        return pd.concat(out[1:] if len(out) > 1 else out)

    partial = met.applyInPandas(best, schema)
    return partial.groupBy("event_id", "id").agg(F.max("score").alias("score"), F.min_by("probe", F.struct(-F.col("score"), F.col("probe"))).alias("probe"))


def probe_summary(vectors: DataFrame, probes: DataFrame, window: str, ident: str, vector: str, rows_per_block: int = 4096, probes_per_block: int = 256) -> DataFrame:
    """(event_id, scored, mean_best, best) over the vectors of the event's window, each with its best probe. Ids have one vector each.

    One row of sums for each event leaves a block. Only of an event whose probes are more than a block the vectors' scores do, to meet those of its other probes.
    """
    met, kinds = _met(vectors, probes, window, ident, vector, rows_per_block, probes_per_block)

    def sums(rows: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"event_id": [], "id": [], "n": [], "total": [], "best": []})]
        if len(rows) and len(mine):
            matrix = np.stack(rows["_v"].to_numpy())
            for event, group in mine.sort_values("probe").groupby("event_id"):
                score, _ = _best_probes(matrix, group)
                whole = group["_parts"].iloc[0] == 1
                out.append(pd.DataFrame({"event_id": event, "id": [None] if whole else rows["_id"].to_numpy(), "n": [len(score)] if whole else 1,
                                         "total": [score.sum()] if whole else score, "best": [score.max()] if whole else score}))
        return pd.concat(out[1:] if len(out) > 1 else out)

    partial = cut_point(met.applyInPandas(sums, f"event_id {kinds['event_id']}, id {kinds['_id']}, n long, total double, best double"), "probe-sums")
    split = partial.filter("id is not null").groupBy("event_id", "id").agg(F.max("best").alias("best")).select("event_id", F.lit(1).cast("long").alias("n"), F.col("best").alias("total"), "best")
    both = partial.filter("id is null").select("event_id", "n", "total", "best").unionByName(split)
    return both.groupBy("event_id").agg(F.sum("n").alias("scored"), (F.sum("total") / F.sum("n")).alias("mean_best"), F.max("best").alias("best"))


def pool_fragments(scores: DataFrame, owners: DataFrame) -> DataFrame:
    """Every post of an event with the score of its best fragment; a post without fragments scores -1. `scores` has posts as ids."""
    best = scores.select("event_id", F.col("id").alias("owner_id"), "score")
    return owners.join(best, ["event_id", "owner_id"], "left").withColumn("score", F.coalesce("score", F.lit(-1.0)))


def candidates(scores: DataFrame, keys: Sequence[str], score: str, ident: str, top_k: int | None = None, floor: float | None = None,
               lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """Posts in score order, ties by id, above the floor and within the first K."""
    kept = scores if floor is None else scores.filter(F.col(score) >= floor)
    if top_k is None:
        return rank_by_score(kept, keys, score, ident, lo, hi)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), ident))      # cut to K rows of a key before the shuffle
    return kept.withColumn("rank", place).filter(F.col("rank") <= top_k).withColumn("rank", F.col("rank").cast("long"))


def space_check(stored: DataFrame, variants: DataFrame, ident: str) -> DataFrame:
    """Mean cosine between stored vectors and each variant's vectors of the same posts; the best variant is marked."""
    pairs = stored.select(ident, F.col("vector").alias("_a")).join(variants.select(ident, "variant", F.col("vector").alias("_b")), ident)
    dot = F.aggregate(F.zip_with("_a", "_b", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    means = pairs.groupBy("variant").agg(F.avg(dot).alias("mean_cosine"))
    # One row per variant.
    best = F.row_number().over(Window.orderBy(F.desc(F.round("mean_cosine", 12)), "variant")) == 1
    return means.withColumn("is_best", best)


def rerank_pool(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Over (post, probe, score): the best score and the probe that gave it (ties to the first probe)."""
    return scores.groupBy(*keys).agg(F.max("score").alias("rerank_score"), F.max_by("probe", F.struct(F.col("score"), -F.col("probe"))).alias("rerank_probe"))


def review_sample(ranked: DataFrame, keys: Sequence[str], rank: str, score: str, cut: float, top: int = 50, near: int = 30, around: float = 0.1) -> DataFrame:
    """The first `top` posts and the first `near` within `around` of the cut, each post once."""
    keys = list(keys)
    close = ranked.filter((F.col(score) >= cut - around) & (F.col(score) < cut + around))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(rank))
    close = close.withColumn("_rn", place).filter(F.col("_rn") <= near).drop("_rn")
    return ranked.filter(F.col(rank) <= top).unionByName(close).dropDuplicates([*keys, rank])


def added_dropped(old: DataFrame, new: DataFrame, new_candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys only in the new set and keys only in the old one, with what the new run scored the dropped."""
    keys = list(keys)
    added = new.join(old.select(*keys), keys, "left_anti").select(*keys, F.lit("added").alias("direction"), "score", F.lit(None).cast("double").alias("new_score"))
    dropped = old.join(new.select(*keys), keys, "left_anti").join(new_candidates.select(*keys, F.col("score").alias("new_score")), keys, "left")
    return added.unionByName(dropped.select(*keys, F.lit("dropped").alias("direction"), "score", "new_score"))
