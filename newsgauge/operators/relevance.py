"""Judging relevance: cuts, weighted confusion, AUC, sampling by bands, readers, votes and study gates.

Every metric works on one long table (event, post, score, label, weight). Scores are first counted per
value; curves and cuts then live on a grid of four decimals, so a window never holds more than the grid.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.functions.text import uniform
from newsgauge.operators.scaling import rank_by_digest, score_block
from newsgauge.session import summary

GRID = 10_000


def weight_where(condition: Column, weight: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0.0))


def f1_of(tp: Column, fp: Column, on: Column) -> Column:
    return F.coalesce(2 * tp / F.nullif(on + tp + fp, F.lit(0.0)), F.lit(0.0))


def confusion(df: DataFrame, keys: Sequence[str], kept: Column, truth: str, weight: str) -> DataFrame:
    """Weighted hits, false alarms, losses and F1 of a kept flag."""
    t = F.col(truth)
    base = df.groupBy(*keys).agg(weight_where(t & kept, weight).alias("tp"), weight_where(~t & kept, weight).alias("fp"),
                                 weight_where(t, weight).alias("on_event"))
    tp, fp, on = F.col("tp"), F.col("fp"), F.col("on_event")
    return base.select(*keys, tp, fp, (on - tp).alias("lost"), fp.alias("extra"), (tp + fp).alias("kept"), on, f1_of(tp, fp, on).alias("f1"))


def grid_mass(df: DataFrame, keys: Sequence[str], score: str, truth: str, weight: str) -> DataFrame:
    """Positive and negative weight per grid step, and which steps are some score rounded to four decimals.

    A post counts at a cut when its unrounded score reaches the rounded cut; a score that was rounded up
    therefore counts one step lower than the cut it proposes.
    """
    step = F.round(F.round(score, 4) * GRID).cast("int")
    reach = F.when(F.col(score) >= step / F.lit(float(GRID)), step).otherwise(step - 1)
    t = F.col(truth)
    fine = df.groupBy(*keys, step.alias("_c"), reach.alias("_r")).agg(weight_where(t, weight).alias("_p"), weight_where(~t, weight).alias("_q"))
    mass = fine.groupBy(*keys, F.col("_r").alias("step")).agg(F.sum("_p").alias("pos"), F.sum("_q").alias("neg"), F.lit(0).alias("is_cut"))
    cuts = fine.select(*keys, F.col("_c").alias("step"), F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"), F.lit(1).alias("is_cut")).distinct()
    return mass.unionByName(cuts).groupBy(*keys, "step").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("is_cut").alias("is_cut"))


def curve(mass: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Confusion at every possible cut: totals of the grid from the top."""
    down = Window.partitionBy(*keys).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    tp, fp, on = F.col("tp"), F.col("fp"), F.col("on_event")
    return (
        mass.withColumn("tp", F.sum("pos").over(down)).withColumn("fp", F.sum("neg").over(down)).withColumn("on_event", F.sum("pos").over(whole))
        .filter("is_cut = 1")
        .select(*keys, (F.col("step") / F.lit(float(GRID))).alias("cut"), tp, fp, on, (on - tp).alias("lost"), f1_of(tp, fp, on).alias("f1")))


def cut_curve(df: DataFrame, keys: Sequence[str], score: str, truth: str, weight: str) -> DataFrame:
    return curve(grid_mass(df, keys, score, truth, weight), keys)


def pick_best(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cut with the highest F1; the lowest of equals."""
    best = F.max_by(F.struct("cut", "f1", "tp", "fp", "on_event", "lost"), F.struct(F.round("f1", 12), -F.col("cut")))
    return curve.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def best_cut(df: DataFrame, keys: Sequence[str], score: str, truth: str, weight: str) -> DataFrame:
    return pick_best(cut_curve(df, keys, score, truth, weight), keys)


def weighted_auc(df: DataFrame, keys: Sequence[str], score: str, truth: str, weight: str, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Weighted share of (on, off) pairs in the right order, ties half; from sums of weight, never from pairs."""
    t = F.col(truth)
    values = df.groupBy(*keys, score).agg(weight_where(t, weight).alias("_p"), weight_where(~t, weight).alias("_q")).withColumn(
        "_b", score_block(F.col(score), lo, hi, descending=False))
    prior = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    below = values.groupBy(*keys, "_b").agg(F.sum("_q").alias("_bq")).select(*keys, "_b", F.coalesce(F.sum("_bq").over(prior), F.lit(0.0)).alias("_below"))
    inside = Window.partitionBy(*keys, "_b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    placed = values.withColumn("_in", F.coalesce(F.sum("_q").over(inside), F.lit(0.0))).join(below, [*keys, "_b"])
    area = F.sum(F.col("_p") * (F.col("_below") + F.col("_in") + 0.5 * F.col("_q")))
    return placed.groupBy(*keys).agg((area / F.nullif(F.sum("_p") * F.sum("_q"), F.lit(0.0))).alias("auc"))


def rank_auc(ranked: DataFrame, keys: Sequence[str], rank: str, truth: str) -> DataFrame:
    """Mann–Whitney AUC on ordinal ranks (1 = lowest score; ties keep their order)."""
    pos, n = F.count_if(F.col(truth)).cast("double"), F.count(F.lit(1))
    total = F.sum(F.when(F.col(truth), F.col(rank))).cast("double")
    return ranked.groupBy(*keys).agg(((total - pos * (pos + 1) / 2) / F.nullif(pos * (n - pos), F.lit(0.0))).alias("auc"))


def recall_at(ranked: DataFrame, keys: Sequence[str], rank: str, truth: Column, ks: Sequence[int]) -> DataFrame:
    """Share of the relevant posts among the first K, for each K."""
    total = F.greatest(F.count_if(truth), F.lit(1))
    wide = ranked.groupBy(*keys).agg(*[(F.count_if(truth & (F.col(rank) <= k)).cast("double") / total).alias(f"k{k}") for k in ks])
    pairs = ", ".join(f"{k}, k{k}" for k in ks)
    return wide.selectExpr(*keys, f"stack({len(ks)}, {pairs}) as (k, recall)")


def precision_recall_pool(pool: DataFrame, keys: Sequence[str], ranks: Mapping[str, str], relevant: str, ks: Sequence[int]) -> DataFrame:
    """Hits, precision and recall of the pool's relevant posts at each K, per method."""
    r = F.col(relevant)
    aggs = [F.count_if(r & (F.col(c) <= k)).alias(f"{m}_{k}") for m, c in ranks.items() for k in ks]
    wide = pool.groupBy(*keys).agg(*aggs, F.count_if(r).alias("_rel"))
    pairs = ", ".join(f"'{m}', {k}, {m}_{k}" for m in ranks for k in ks)
    return wide.selectExpr(*keys, "_rel", f"stack({len(ranks) * len(ks)}, {pairs}) as (method, k, hits)").select(
        *keys, "method", "k", "hits", F.round(F.col("hits").cast("double") / F.col("k"), 3).alias("precision"),
        F.round(F.col("hits").cast("double") / F.greatest("_rel", F.lit(1)), 3).alias("recall_of_pool"))


def threshold_sweep(df: DataFrame, keys: Sequence[str], scorers: Mapping[str, str], truth: str, thresholds: Sequence[float]) -> DataFrame:
    """Kept, on-event kept, on-event lost and off-event kept at each threshold, one pass over the rows."""
    t = F.col(truth)
    aggs = [F.count_if(t).alias("_on")]
    rows = []
    for name, column in scorers.items():
        for i, cut in enumerate(thresholds):
            aggs += [F.count_if(F.col(column) >= cut).alias(f"{name}_{i}_k"), F.count_if(t & (F.col(column) >= cut)).alias(f"{name}_{i}_o")]
            rows.append(f"'{name}', double({cut}), {name}_{i}_k, {name}_{i}_o")
    wide = df.groupBy(*keys).agg(*aggs)
    return wide.selectExpr(*keys, "_on", f"stack({len(rows)}, {', '.join(rows)}) as (scorer, threshold, kept, on_event_kept)").select(
        *keys, "scorer", "threshold", "kept", "on_event_kept", (F.col("_on") - F.col("on_event_kept")).alias("on_event_lost"),
        (F.col("kept") - F.col("on_event_kept")).alias("off_event_kept"))


# ---------------------------------------------------------------------------- sampling
def width_bands(df: DataFrame, keys: Sequence[str], score: str, bands: int = 10) -> DataFrame:
    """Equal-width bands over each key's score range; the last band is closed."""
    spread = summary(df.groupBy(*keys).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi")))
    share = (F.col(score) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return df.join(spread, list(keys)).withColumn("band", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bands), F.lit(bands - 1)).cast("int")).drop("_lo", "_hi")


def take_per_band(banded: DataFrame, keys: Sequence[str], band: str, ident: str, per_band: int, seed: str) -> DataFrame:
    """`per_band` posts of each band in a seeded order, weighted back to the band's size."""
    keys = list(keys)
    sizes = banded.groupBy(*keys, band).agg(F.count(F.lit(1)).alias("_size"))
    order = Window.partitionBy(*keys, band).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(ident))))
    picked = banded.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= per_band).drop("_rn")
    return picked.join(sizes, keys + [band]).withColumn("weight", F.col("_size").cast("double") / F.least(F.col("_size"), F.lit(per_band))).drop("_size")


def rank_band(rank: Column, edges: Sequence[int]) -> Column:
    """The number of the rank band (lo, hi] a rank falls in; NULL beyond the last edge."""
    band = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        band = F.when((rank > edges[i]) & (rank <= edges[i + 1]), i).otherwise(band)
    return band


# The multipliers of a common 32-bit finaliser and of the golden ratio.
_MIX, _SPREAD = (2246822507, 3266489909), (2654435769, 2246822519)


def _shuffled(digest: np.ndarray, seeds: np.ndarray, spread: int) -> np.ndarray:
    """32 bits for each digest and each seed, as even and as independent as a hash of both."""
    x = digest[:, None].astype(np.uint64) ^ (seeds * np.uint64(spread) & np.uint64(0xFFFFFFFF))
    for shift, times in ((16, _MIX[0]), (13, _MIX[1])):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(16))


class Reservoirs:
    """For each seed the `size` rows with the smallest draws. Once a reservoir is full, a row above its greatest draw is passed over."""

    def __init__(self, size: int, seeds: int):
        self.size, self.seeds = size, seeds
        self.limit = np.full(seeds, np.inf)
        self.draw, self.seed, self.row, self.rows = np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64), None

    def offer(self, rows: pd.DataFrame, draws: np.ndarray) -> None:
        at, seed = np.nonzero(draws < self.limit)
        if len(at):
            taken, number = np.unique(at, return_inverse=True)
            held = 0 if self.rows is None else len(self.rows)
            self.rows = rows.iloc[taken] if self.rows is None else pd.concat([self.rows, rows.iloc[taken]])
            self.draw, self.seed, self.row = (np.concatenate(p) for p in ((self.draw, draws[at, seed]), (self.seed, seed), (self.row, number + held)))
            self.prune()

    def prune(self) -> None:
        order = np.lexsort((self.draw, self.seed))
        seed = self.seed[order]
        first = np.searchsorted(seed, np.arange(self.seeds))
        place = np.arange(len(order)) - first[seed]
        full = np.searchsorted(seed, np.arange(self.seeds), side="right") - first >= self.size
        self.limit[full] = self.draw[order[first[full] + self.size - 1]]
        keep = order[place < self.size]
        used, row = np.unique(self.row[keep], return_inverse=True)
        self.draw, self.seed, self.row, self.rows = self.draw[keep], self.seed[keep], row, self.rows.iloc[used]

    def result(self) -> pd.DataFrame:
        return self.rows.iloc[self.row].assign(seed=(self.seed + 1).astype(np.int32), _draw=self.draw)


def sample_picks(df: DataFrame, keys: Sequence[str], ident: str, score: str, weight: str, n: int, seeds: int, bands: int = 10, chunk: int = 4096) -> DataFrame:
    """For every seed, n // bands posts per score band, drawn by weight without replacement.

    A post's draw is -ln(u)/weight with u from a digest of (key, post) shuffled by the seed; the smallest draws equal successive weighted draws.
    The rows are read once for all seeds: a task fills a reservoir for each band and seed, and only reservoirs leave it.
    Skipping ahead by random jumps would draw the same way, but not the same posts again when a task is run again over other partitions.
    """
    keys = list(keys)
    per = max(1, n // bands)
    banded = width_bands(df, keys, score, bands)
    mass = summary(banded.groupBy(*keys, "band").agg(F.sum(weight).alias("_mass"), F.count(F.lit(1)).alias("_size")))
    digest = F.md5(F.concat_ws("|", *keys, ident))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    number = np.arange(1, seeds + 1).astype(np.uint64)

    def fill(batches):
        held: dict[tuple, Reservoirs] = {}
        for b in batches:
            for key, rows in b.groupby([*keys, "band"], sort=False, dropna=False):
                mine = held.setdefault(tuple("" if x is None else x for x in key), Reservoirs(per, seeds))
                for a in range(0, len(rows), chunk):
                    r = rows.iloc[a:a + chunk]
                    high, low = _shuffled(r["_h"].to_numpy(), number, _SPREAD[0]), _shuffled(r["_l"].to_numpy(), number, _SPREAD[1])
                    u = ((high >> np.uint64(5)) * np.uint64(1 << 26) + (low >> np.uint64(6)) + np.uint64(1)).astype(np.float64) / 9007199254740993.0
                    mine.offer(r.drop(columns=["_h", "_l"]), -np.log(u) / r[weight].to_numpy(dtype=float)[:, None])
        for r in held.values():
            if r.rows is not None:
                yield r.result()
    types = ", ".join(f"`{c}` {kind}" for c, kind in banded.dtypes)
    drawn = banded.withColumns({"_h": part(1), "_l": part(9)}).mapInPandas(fill, f"{types}, seed int, _draw double")
    order = Window.partitionBy(*keys, "band", "seed").orderBy("_draw", ident)
    picked = drawn.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= per)
    return picked.join(mass, keys + ["band"]).withColumn("sample_weight", F.col("_mass") / F.least(F.col("_size"), F.lit(per))).drop("_rn", "_mass", "_size", "_draw")


def sample_cut(df: DataFrame, keys: Sequence[str], ident: str, score: str, truth: str, weight: str, n: int = 60, seeds: int = 200,
               picked_on: str | None = None) -> DataFrame:
    """Per seed the cut picked on a small labelled sample, with its F1, losses and extras on all labels."""
    keys = list(keys)
    cols = list(dict.fromkeys([*keys, ident, score, truth, weight, *([picked_on] if picked_on else [])]))
    picks = sample_picks(df.select(*cols), keys, ident, score, weight, n, seeds)
    chosen = best_cut(picks, [*keys, "seed"], score, picked_on or truth, "sample_weight").select(*keys, "seed", "cut")
    return chosen.join(cut_curve(df, keys, score, truth, weight), [*keys, "cut"])


def sample_summary(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean F1, its tenth percentile, mean losses and extras over the seeds (a fixed number of runs per key)."""
    return runs.groupBy(*keys).agg(F.avg("f1").alias("f1"), F.percentile("f1", 0.1).alias("f1_p10"), F.avg("lost").alias("lost"), F.avg("fp").alias("extra"))


def leave_one_out_cut(df: DataFrame, event: str, score: str, truth: str, weight: str) -> DataFrame:
    """For each event the best pooled cut of all other events, and how it does on the event itself.

    The others are the pooled grid minus the event's own steps, so no row meets another event's rows.
    """
    own = grid_mass(df, [event], score, truth, weight)
    total = own.groupBy("step").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("is_cut").alias("n_cut"))
    # One row holding at most 10,001 grid steps.
    steps = total.agg(F.collect_list(F.struct("step", "pos", "neg", "n_cut")).alias("_s"))
    mine = own.select(event, "step", F.col("pos").alias("_p"), F.col("neg").alias("_q"), F.col("is_cut").alias("_c"))
    others = (
        own.select(event).distinct().crossJoin(F.broadcast(steps)).select(event, F.explode("_s").alias("_e")).select(event, "_e.*")
        .join(mine, [event, "step"], "left")
        .select(event, "step", (F.col("pos") - F.coalesce("_p", F.lit(0.0))).alias("pos"), (F.col("neg") - F.coalesce("_q", F.lit(0.0))).alias("neg"),
                ((F.col("n_cut") - F.coalesce("_c", F.lit(0))) > 0).cast("int").alias("is_cut")))
    cuts = summary(pick_best(curve(others, [event]), [event]).select(event, F.col("cut").alias("global_cut")))
    scored = df.join(cuts, event)
    return confusion(scored, [event, "global_cut"], F.col(score) >= F.col("global_cut"), truth, weight)


# ---------------------------------------------------------------------------- judges and readers
def majority(df: DataFrame, judges: Sequence[str]) -> DataFrame:
    """Votes and majority of three label sets, for posts all of them labelled."""
    whole = df.dropna(subset=list(judges))
    votes = sum((F.col(j).cast("int") for j in judges[1:]), F.col(judges[0]).cast("int"))
    return whole.withColumn("votes", votes).withColumn("majority", F.col("votes") * 2 > len(judges))


def agreed_only(df: DataFrame, keys: Sequence[str], a: str, b: str, weight: str) -> DataFrame:
    """Posts two judges agree on, weights raised so each weight group keeps its total."""
    group = [*keys, weight]
    scale = df.groupBy(*group).agg((F.count(F.lit(1)).cast("double") / F.greatest(F.count_if(F.col(a) == F.col(b)), F.lit(1))).alias("_x"))
    return df.filter(F.col(a) == F.col(b)).join(scale, group).withColumn("agreed_weight", F.col(weight) * F.col("_x")).drop("_x")


def stop_rule(ranked: DataFrame, keys: Sequence[str], rank: str, score: str, batch: int, floor: float, yes: float = 0.5) -> DataFrame:
    """How deep scoring goes when it stops after the first batch with fewer than `floor` yes answers."""
    keys = list(keys)
    batches = ranked.groupBy(*keys, F.floor((F.col(rank) - 1) / batch).alias("_b")).agg(
        F.avg((F.col(score) >= yes).cast("double")).alias("_share"), F.count(F.lit(1)).alias("_n"))
    first = F.min(F.when(F.col("_share") < floor, F.col("_b")))
    return batches.groupBy(*keys).agg(F.least((F.coalesce(first + 1, F.max("_b") + 1) * batch).cast("long"), F.sum("_n")).alias("depth"))


def slices(df: DataFrame, keys: Sequence[str], ident: str, seed: str, size: int) -> DataFrame:
    """A seeded permutation cut into slices of a fixed size."""
    d = df.withColumn("_d", F.md5(F.concat_ws("|", F.lit(seed), F.col(ident))))
    return rank_by_digest(d, keys, "_d", "place").withColumn("slice", F.floor((F.col("place") - 1) / size).cast("long")).drop("_d")


def collect_answers(answers: DataFrame, asked: DataFrame, keys: Sequence[str], min_share: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Answers (key, raw_id, answer, slice) to labels: ids of digits only, the later slice wins, scores in 0–100.

    Returns the labels and, per key, how many asked posts were answered and whether that is enough.
    """
    keys = list(keys)
    valid = answers.withColumn("_id", F.trim("raw_id")).filter(F.col("_id").rlike(r"^\d+$")).withColumn("post_id", F.col("_id").cast("long"))
    labels = valid.groupBy(*keys, "post_id").agg(F.max_by("answer", "slice").alias("answer")).withColumn(
        "answer", F.least(F.greatest("answer", F.lit(0)), F.lit(100)))
    got = asked.select(*keys, "post_id").join(labels, [*keys, "post_id"], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("asked"), F.count("answer").alias("answered"))
    return labels, got.withColumn("missing", F.col("asked") - F.col("answered")).withColumn("accepted", F.col("answered") >= F.col("asked") * min_share)


def era_means(rows: DataFrame, event_year: Column, values: Sequence[str], last_early_year: int = 2022) -> DataFrame:
    era = F.when(event_year <= last_early_year, f"to {last_early_year}").otherwise(f"from {last_early_year + 1}")
    return rows.groupBy(era.alias("era")).agg(F.count(F.lit(1)).alias("events"), *[F.avg(v).alias(v) for v in values])
