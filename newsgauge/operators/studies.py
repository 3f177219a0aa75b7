"""Whole studies over the relevance operators: scorer and reader comparisons, gates, exports and costs."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.operators import relevance as RL


def run_metrics(df: DataFrame, event: str, runs: Mapping[str, Column], truth: str, yes: float = 0.5) -> DataFrame:
    """Unweighted errors, F1 and AUC of each run per event."""
    out = None
    for name, score in runs.items():
        d = df.select(event, truth, score.alias("_s"), F.lit(1.0).alias("_one"))
        c = RL.confusion(d, [event], F.col("_s") >= yes, truth, "_one").select(event, (F.col("lost") + F.col("extra")).cast("long").alias("errors"), "f1")
        part = c.join(RL.weighted_auc(d, [event], "_s", truth, "_one"), event).withColumn("run", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def acceptance_gates(runs: DataFrame, event: str, base: str = "base", new: str = "new", auc_drop: float = 0.005, f1_drop: float = 0.02) -> DataFrame:
    """Whether the new variant may replace the base: errors, macro F1, macro AUC, and F1 per event.

    An event's F1 may fall by 0.02 or by the spread between the base's own repeats, whichever is more.
    """
    r = runs.withColumn("_v", F.split("run", "_")[0])

    def at(variant: str, value: Column) -> Column:
        return F.when(F.col("_v") == variant, value)

    eps = 1e-12
    total = r.agg(*[f(at(v, F.col(c))).alias(f"{v}_{c}") for v in (base, new) for f, c in ((F.sum, "errors"), (F.avg, "f1"), (F.avg, "auc"))])
    gates = F.array(
        F.struct(F.lit("errors not more").alias("gate"), (F.col(f"{new}_errors") <= F.col(f"{base}_errors")).alias("passed")),
        F.struct(F.lit("macro F1 not lower").alias("gate"), (F.col(f"{new}_f1") + eps >= F.col(f"{base}_f1")).alias("passed")),
        F.struct(F.lit("macro AUC within limit").alias("gate"), (F.col(f"{new}_auc") + auc_drop + eps >= F.col(f"{base}_auc")).alias("passed")))
    repeats = r.groupBy(event).agg(
        (F.avg(at(base, F.col("f1"))) - F.avg(at(new, F.col("f1")))).alias("drop"), (F.max(at(base, F.col("f1"))) - F.min(at(base, F.col("f1")))).alias("spread"))
    per_event = repeats.select(F.concat(F.lit("F1 drop within limit: "), event).alias("gate"),
                               (F.col("drop") <= F.greatest(F.lit(f1_drop), F.col("spread")) + eps).alias("passed"))
    return total.select(F.explode(gates).alias("g")).select("g.*").unionByName(per_event)


def completeness(candidates: DataFrame, scored: DataFrame, sample_now: DataFrame, sample_then: DataFrame, event: str, ident: str, allowed: int = 5) -> DataFrame:
    """Per event the candidates without a score, and whether the cut's sample is the one today's scores give."""
    key = [event, ident]
    missing = candidates.join(scored.select(*key, F.lit(1).alias("_s")), key, "left").groupBy(event).agg(F.count_if(F.col("_s").isNull()).alias("missing"))
    moved = (
        sample_now.withColumn("_a", F.lit(1)).join(sample_then.withColumn("_b", F.lit(1)), key, "full")
        .groupBy(event).agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("_moved")))
    return missing.join(moved, event, "left").select(event, "missing", (F.col("missing") <= allowed).alias("complete"),
                                                     (F.coalesce("_moved", F.lit(0)) == 0).alias("sample_is_current"))


def export_matches(candidates: DataFrame, cuts: DataFrame, incomplete: DataFrame, event: str, ident: str, cos: str, score: str) -> DataFrame:
    """Posts at or above each event's cut; an event with nothing kept is one row marked empty.

    A sample without a positive sets the cut out of reach (1.01). Incomplete events are held back.
    """
    usable = cuts.withColumn("cut", F.when(F.col("positives") > 0, F.col("cut")).otherwise(1.01)).join(incomplete.select(event), event, "left_anti").select(event, "cut")
    kept = candidates.join(usable, event).filter(F.col(score) >= F.col("cut")).select(event, ident, cos, score, "cut", F.lit(False).alias("is_empty"))
    none = usable.join(kept.select(event).distinct(), event, "left_anti")
    types = dict(candidates.dtypes)
    empty = none.select(event, *[F.lit(None).cast(types[c]).alias(c) for c in (ident, cos, score)], "cut", F.lit(True).alias("is_empty"))
    return kept.unionByName(empty)


def macro_average(methods: Mapping[str, DataFrame], usd: Mapping[str, float]) -> DataFrame:
    """Precision, recall and F1 averaged over events, each event weighing the same, with a method's cost."""
    out = None
    for name, conf in methods.items():
        p = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0.0)), F.lit(0.0))
        r = F.col("tp") / F.col("on_event")
        part = conf.select(p.alias("p"), r.alias("r")).agg(
            F.avg("p").alias("precision"), F.avg("r").alias("recall"),
            F.avg(F.coalesce(2 * F.col("p") * F.col("r") / F.nullif(F.col("p") + F.col("r"), F.lit(0.0)), F.lit(0.0))).alias("f1")).select(
            F.lit(name).alias("method"), "precision", "recall", "f1", F.lit(usd[name]).alias("usd"))
        out = part if out is None else out.unionByName(part)
    return out


def compare_scorers(df: DataFrame, event: str, ident: str, scorers: Mapping[str, str], truth: str, weight: str) -> DataFrame:
    """AUC, best F1 and sample-cut F1, losses and extras of several scorers side by side, with their means."""
    wide = None
    for name, score in scorers.items():
        auc = RL.weighted_auc(df, [event], score, truth, weight).withColumnRenamed("auc", f"auc_{name}")
        best = RL.best_cut(df, [event], score, truth, weight).select(event, F.col("f1").alias(f"best_{name}"))
        drawn = RL.sample_summary(RL.sample_cut(df, [event], ident, score, truth, weight), [event]).select(
            event, F.col("f1").alias(f"sample_{name}"), F.col("lost").alias(f"lost_{name}"), F.col("extra").alias(f"extra_{name}"))
        part = auc.join(best, event).join(drawn, event)
        wide = part if wide is None else wide.join(part, event)
    values = [c for c in wide.columns if c != event]
    return wide.unionByName(wide.agg(*[F.avg(c).alias(c) for c in values]).withColumn(event, F.lit("mean")))


def reader_gaps(df: DataFrame, event: str, score: str, truth: str, weight: str, usd: Mapping[str, float], behind: float = -0.02) -> DataFrame:
    """How far each reader's cut falls behind the reference's: mean, worst event, events behind, agreement, cost."""
    curve = RL.cut_curve(df, [event], score, truth, weight)
    reference = RL.pick_best(curve, [event]).select(event, F.col("f1").alias("_ref"))
    rows = None
    for who, cost in usd.items():
        read = df.withColumn("_lab", F.coalesce(F.col(who), F.col(truth)))
        cut = RL.best_cut(read, [event], score, "_lab", weight).select(event, "cut")
        agree = read.groupBy(event).agg(F.avg((F.col("_lab") == F.col(truth)).cast("int")).alias("agree"), F.count(F.lit(1)).alias("n"))
        part = curve.join(cut, [event, "cut"]).join(reference, event).join(agree, event).select(
            event, F.lit(who).alias("who"), (F.col("f1") - F.col("_ref")).alias("gap"), "agree", "n", F.lit(cost).alias("usd"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("who").agg(
        F.avg("gap").alias("mean_gap"), F.min("gap").alias("worst_gap"), F.min_by(event, F.struct(F.round("gap", 12), F.col(event))).alias("worst_event"),
        F.count_if(F.col("gap") < behind).alias("behind"), F.avg("agree").alias("mean_agree"), F.min("agree").alias("min_agree"),
        (F.sum("usd") / F.sum("n") * 100).alias("usd_per_100"))


def variant_saving(rows: DataFrame, base: str) -> DataFrame:
    """Cost per post, saving and change of F1 against the base variant (one row per variant)."""
    means = rows.groupBy("variant").agg(F.avg("tokens").alias("tokens"), F.avg("f1").alias("f1"))
    ref = means.filter(F.col("variant") == base).select(F.col("tokens").alias("_t"), F.col("f1").alias("_f"))
    return means.crossJoin(F.broadcast(ref)).select("variant", "tokens", (1 - F.col("tokens") / F.col("_t")).alias("saving"), "f1", (F.col("f1") - F.col("_f")).alias("f1_change"))
