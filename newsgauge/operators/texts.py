"""Operators on running text: repeated endings, budgets, turn order, typical phrases, repeats and top words."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.functions.text import squeeze
from newsgauge.operators.scaling import rank_by_id, rank_in_blocks, running_sum
from newsgauge.session import cut_point, summary

# Signs that an ending is about running a channel.
FOOTER_MARKERS = ["@", "t.me", "http", "подпис", "подпиш", "subscribe", "|", "¦", "прислать", "наш канал", "канал в", "по ссылке"]
FOOTER_EDGE = " |¦-–—:•·"


def find_footers(posts: DataFrame, groups: Sequence[str], text: str, min_posts: int = 20, min_share: float = 0.05,
                 share_without_marker: float = 0.30, max_words: int = 25, markers: Sequence[str] = tuple(FOOTER_MARKERS)) -> DataFrame:
    """Endings of 2 to 25 words that a group's posts repeat, shorter than the post they end. A group is a source and a month: channels change their footers."""
    groups = list(groups)
    long_enough = posts.select(*groups, F.split(F.col(text), " ").alias("_w")).filter(F.size("_w") > 2).withColumn(
        "_tail", F.array_join(F.slice("_w", -2, 2), " "))
    totals = summary(posts.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")))
    often = F.col("posts_ending") >= F.greatest(F.lit(float(min_posts)), F.col("_n") * min_share)
    # An ending is never more frequent than its own last two words, so only posts with frequent last
    # words are spread into their endings.
    frequent = (
        long_enough.groupBy(*groups, "_tail").agg(F.count(F.lit(1)).alias("posts_ending")).filter(F.col("posts_ending") >= min_posts)
        .join(totals, groups).filter(often).select(*groups, "_tail"))
    lengths = F.sequence(F.lit(2), F.least(F.lit(max_words), F.size("_w") - 1))
    endings = (
        long_enough.join(summary(frequent), [*groups, "_tail"], "left_semi")
        .select(*groups, F.explode(F.transform(lengths, lambda k: F.array_join(F.slice("_w", -k, k), " "))).alias("ending"))
        .groupBy(*groups, "ending").agg(F.count(F.lit(1)).alias("posts_ending")))
    marked = F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(F.lower("ending"), m))
    share = F.col("posts_ending") / F.col("_n")
    return (
        endings.filter(F.col("posts_ending") >= min_posts).join(totals, groups)
        .filter(often).withColumn("has_marker", marked).withColumn("share", share)
        .filter(F.col("has_marker") | (F.col("share") >= share_without_marker)).drop("_n"))


def strip_footers(posts: DataFrame, ident: str, text: str, footers: DataFrame, passes: int = 4) -> DataFrame:
    """Drop known endings, longest first, up to four times; endings of all groups are pooled.

    Endings are kept as one list per last two words, longest first, so a post meets one row and the first that fits is cut. Only posts that lost an
    ending are looked at again.
    """
    def tail(column: str):
        return F.array_join(F.slice(F.split(F.col(column), " "), -2, 2), " ")

    pool = footers.select("ending").distinct().withColumn("_tail", tail("ending"))
    lists = summary(pool.groupBy("_tail").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.length("ending")).alias("n"), F.col("ending").alias("e")))), lambda x: x["e"]).alias("_ends")))

    def once(rows: DataFrame) -> DataFrame:
        """Each text without the ending that fits, and whether one did."""
        fits = F.filter("_ends", lambda e: F.endswith(F.col("_t"), e) & (F.length("_t") > F.length(e)))
        met = rows.join(lists, F.col("_k") == F.col("_tail"), "left").select(ident, "_t", F.get(fits, F.lit(0)).alias("_e"))
        rest = F.rtrim(F.substring(F.col("_t"), F.lit(1), F.length("_t") - F.length("_e")), F.lit(FOOTER_EDGE))
        return met.select(ident, F.coalesce(rest, "_t").alias("_t"), F.col("_e").isNotNull().alias("_hit"))

    several = F.size(F.split("_t", " ")) >= 2
    spread = F.concat(F.lit("\0"), F.col(ident).cast("string"))              # a key that no ending has, another for every post
    first = cut_point(once(posts.select(ident, F.col(text).alias("_t")).withColumn("_k", F.when(several, tail("_t")).otherwise(spread))), "stripped")
    again = first.filter("_hit")
    for _ in range(passes - 1):
        again = once(again.withColumn("_k", F.when(F.col("_hit") & several, tail("_t")).otherwise(spread)))
    return first.filter("not _hit").unionByName(again).select(ident, F.col("_t").alias(text))


def interleave(rows: DataFrame, group: str, ident: str) -> DataFrame:
    """Round-robin over groups, in-group order kept: `turn` inside the group, `place` over all."""
    turned = rank_by_id(rows, [group], ident, "turn")
    return rank_in_blocks(turned, [], F.shiftright("turn", 12), [F.col("turn"), F.col(group)], "place")


def trim_to_budget(rows: DataFrame, place: str, cost: str, budget: int) -> DataFrame:
    """Rows in order until the running cost first exceeds the budget."""
    return running_sum(rows, place, cost, "running_cost").filter(F.col("running_cost") <= budget)


def repeat_share(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Share of rows whose squeezed lower-case text repeats another one before it (every copy but the first)."""
    copies = rows.groupBy(*keys, F.md5(F.lower(squeeze(F.col(text)))).alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    return copies.groupBy(*keys).agg(((F.sum("_n") - F.count(F.lit(1))).cast("double") / F.sum("_n")).alias("repeat_share"))


def top_words(rows: DataFrame, keys: Sequence[str], text: str, stop: DataFrame, k: int = 6) -> DataFrame:
    """The k most used Latin words of three letters or more, outside the stop list; ties by the word."""
    words = rows.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    counts = words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("uses")).join(stop.select(F.col("term").alias("word")), "word", "left_anti")
    rank = Window.partitionBy(*keys).orderBy(F.desc("uses"), "word")
    return counts.withColumn("place", F.row_number().over(rank).cast("long")).filter(F.col("place") <= k)


def _overlap_bounds(shared: np.ndarray, sizes: np.ndarray) -> tuple[float, float]:
    """Bounds of a phrase's summed overlap, from how many phrases of each size hold each of its words (words x sizes).

    A phrase that shares j words holds one of the rarest len - j + 1 of them, which bounds how many share so many. Overlap grows faster
    than the number of shared words: the sum is greatest where the fewest phrases share the most words they can, and least where each shares one.
    """
    n = len(shared)
    j = np.arange(1, n + 1)[:, None]
    possible = j <= np.minimum(n, sizes)
    total = shared.sum(axis=0)
    at_most = np.minimum.accumulate(np.where(possible, np.cumsum(np.sort(shared, axis=0), axis=0)[::-1], 0), axis=0)
    overlap = j / np.maximum(n + sizes - j, 1)
    step = np.where(possible, np.diff(overlap, axis=0, prepend=0.0), 0.0)
    low, high = np.zeros(len(sizes)), at_most[0].astype(float)
    for _ in range(30):                                                      # so many phrases, filled up in turn, use up all that is shared
        level = (low + high) / 2
        enough = np.minimum(at_most, level).sum(axis=0) >= total
        low, high = np.where(enough, low, level), np.where(enough, level, high)
    return float((total * overlap[0]).sum()), float((np.minimum(at_most, high) * step).sum())


def _phrase_bounds(phrases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _id, _low, _high) of every phrase, by an index of words: how many phrases of each size hold a word. Phrases never meet."""
    keys = list(keys)
    words = phrases.select(*keys, "_id", F.size("_w").alias("_n"), F.explode("_w").alias("_word"))
    index = summary(words.groupBy(*keys, "_word", "_n").agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys, "_word").agg(
        F.collect_list("_n").alias("_sizes"), F.collect_list("_c").alias("_counts")))                # a word has as many entries as there are sizes
    held = words.select(*keys, "_id", "_word").join(index, [*keys, "_word"]).groupBy(*keys, "_id").agg(F.collect_list("_sizes").alias("_sizes"), F.collect_list("_counts").alias("_counts"))

    def bounds(batches):
        for b in batches:
            low, high = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for i, (lists, counts) in enumerate(zip(b.column("_sizes").to_pylist(), b.column("_counts").to_pylist(), strict=True)):
                sizes = np.unique(np.concatenate(lists))
                shared = np.zeros((len(lists), len(sizes)), np.int64)
                for r, (x, c) in enumerate(zip(lists, counts, strict=True)):
                    shared[r, np.searchsorted(sizes, x)] = c
                shared[:, np.searchsorted(sizes, len(lists))] -= 1           # the phrase itself, whose overlap is one
                low[i], high[i] = _overlap_bounds(shared, sizes)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*keys, "_id")], pa.array(low + 1), pa.array(high + 1)], names=[*keys, "_id", "_low", "_high"])
    types = dict(phrases.dtypes)
    return held.mapInArrow(bounds, ", ".join([f"`{k}` {types[k]}" for k in (*keys, "_id")] + ["_low double", "_high double"]))


def _phrase_scores(asked: DataFrame, phrases: DataFrame, keys: Sequence[str], asked_block: int, block: int) -> DataFrame:
    """(keys, _id, _s): the summed overlap of each phrase in `asked` with all phrases of its key.

    Both are dealt into blocks; one task looks the words of some asked phrases up in the inverted index of one block.
    """
    keys = list(keys)
    count = lambda rows, per, name: rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias(name))
    grid = summary(count(asked, asked_block, "_na").join(count(phrases, block, "_nb"), keys))
    deal = lambda n: F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(grid, keys).select(*keys, "_id", "_w", deal("_na").alias("_i"), every("_nb").alias("_j"))
    left = left.select(*[F.col(c).alias(c) for c in left.columns])
    right = phrases.join(grid, keys).select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_w").alias("_rw"), every("_na").alias("_ri"), deal("_nb").alias("_rj"))

    def overlap(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({k: [] for k in keys} | {"_id": [], "_s": []})
        number = {w: i for i, w in enumerate({w for ws in a["_w"] for w in ws})}
        sizes = b["_rw"].map(len).to_numpy()
        word = np.fromiter((number.get(w, -1) for ws in b["_rw"] for w in ws), np.int64, int(sizes.sum()))
        row = np.repeat(np.arange(len(b)), sizes)[word >= 0]
        order = np.argsort(word[word >= 0], kind="stable")
        row, ends = row[order], np.cumsum(np.bincount(word[word >= 0], minlength=len(number)))
        score = np.zeros(len(a))
        for i, ws in enumerate(a["_w"]):
            at = [number[w] for w in ws]
            common = np.bincount(np.concatenate([row[ends[w - 1] if w else 0:ends[w]] for w in at]), minlength=len(b))
            score[i] = (common / (len(ws) + sizes - common)).sum()
        return a[[*keys, "_id"]].assign(_s=score)
    types = dict(phrases.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in (*keys, "_id")] + ["_s double"])
    parts = left.groupBy(*keys, "_i", "_j").cogroup(right.groupBy(*[f"_r_{k}" for k in keys], "_ri", "_rj")).applyInPandas(overlap, schema)
    return parts.groupBy(*keys, "_id").agg(F.round(F.sum("_s"), 9).alias("_s"))


def typical_phrase(rows: DataFrame, keys: Sequence[str], ident: str, text: str, shortest: int = 24, longest: int = 170,
                   first: int = 256, asked_block: int = 1024, block: int = 4096) -> DataFrame:
    """Per key the phrase with the highest summed word overlap (Jaccard) with the key's other phrases.

    Spellings differing in case count once, the earliest stands for them. An index of words gives every phrase a lower and an upper bound. Phrases are
    scored in the order of their upper bound, `first` of a key in the first round and four times as many in each that follows; the best score or lower
    bound so far is a floor, and a phrase whose upper bound lies below it is never scored. Nothing is left out that could be the best.
    """
    keys = list(keys)
    trimmed = rows.select(*keys, F.col(ident).alias("_id"), F.trim(F.col(text)).alias("_p")).filter(F.length("_p").between(shortest, longest))
    cand = trimmed.groupBy(*keys, F.lower("_p").alias("_l")).agg(F.min_by("_p", "_id").alias("_p"), F.min("_id").alias("_id"))
    cand = cut_point(cand.select(*keys, "_id", "_p", F.array_distinct(F.split(squeeze(F.col("_l")), " ")).alias("_w")), "phrases")
    phrases = cand.select(*keys, "_id", "_w")
    pending = cut_point(_phrase_bounds(phrases, keys), "bounds")
    floor, scored = summary(pending.groupBy(*keys).agg(F.max("_low").alias("_floor"))), []
    while True:
        pending = pending.join(floor, keys).filter(F.col("_high") >= F.col("_floor") - 1e-6).drop("_floor")
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_high"), "_id"))
        asked = cut_point(pending.withColumn("_place", place).filter(F.col("_place") <= first).select(*keys, "_id").join(phrases, [*keys, "_id"]), "asked")
        scored.append(cut_point(_phrase_scores(asked, phrases, keys, asked_block, block), "overlaps"))
        found = scored[-1].groupBy(*keys).agg(F.max("_s").alias("_best"))
        floor = summary(floor.join(found, keys, "left").select(*keys, F.greatest("_floor", "_best").alias("_floor")))
        pending = pending.join(asked.select(*keys, "_id"), [*keys, "_id"], "left_anti")
        pending = cut_point(pending.join(floor, keys).filter(F.col("_high") >= F.col("_floor") - 1e-6).drop("_floor"), "pending")
        if pending.isEmpty():
            break
        first *= 4
    scores = scored[0]
    for s in scored[1:]:
        scores = scores.unionByName(s)
    best = scores.groupBy(*keys).agg(F.max_by("_id", F.struct(F.col("_s"), -F.col("_id"))).alias("_id"), F.max("_s").alias("overlap"))
    return best.join(cand.select(*keys, "_id", F.col("_p").alias("phrase")), [*keys, "_id"]).select(*keys, F.col("_id").alias(ident), "phrase", "overlap")
