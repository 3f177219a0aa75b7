"""How groups frame an event: shares, roles, stance, causes, clusters and the tables that compare groups.

Records are nested; three exploded views (messages, labels, mentions) are counted per (event, group, value)
first, and everything after works on those counts.
"""
from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.functions.text import fixed_point

# The role vocabulary and how roles are read.
ROLES = ["liberator", "hero", "defender", "protector", "ally", "beneficiary", "mediator", "victim", "neutral_actor", "other", "aggressor",
         "occupier", "villain", "threat", "perpetrator", "provocateur", "traitor", "bystander"]
APPROVING = ["liberator", "hero", "defender", "protector", "ally", "beneficiary", "mediator"]
CONDEMNING = ["aggressor", "occupier", "villain", "threat", "perpetrator", "provocateur", "traitor"]
FRAMES = ["conflict", "human_interest", "economic_consequences", "morality", "responsibility"]
STATUSES = ["asserted", "attributed", "hedged", "denied", "questioned"]

RECORD = (
    "event string, message_id bigint, source string, media_group string, date string, rerank_score double, text_used string, on_event boolean, "
    "on_event_evidence string, entities array<struct<mention:string,canonical:string,type:string>>, problem_definition string, "
    "problem_definition_evidence string, action_labels array<struct<action:string,term:string,valence:string,evidence:string>>, "
    "causal_attribution struct<cause_entity:string,mechanism:string,evidence:string>, "
    "moral_evaluation array<struct<entity:string,role:string,polarity:int,intensity:int,evidence:string>>, treatment string, "
    "epistemic_status string, epistemic_evidence string, emphasized array<string>, "
    "semetko struct<conflict:boolean,human_interest:boolean,economic_consequences:boolean,morality:boolean,responsibility:boolean>, narrative_id string")

EG = ["event", "media_group"]


def n_rows() -> Column:
    return F.count(F.lit(1))


def role_category(role: Column) -> Column:
    return (F.when(role.isin(*APPROVING), "favourable").when(role.isin(*CONDEMNING), "unfavourable").when(role == "victim", "victim").otherwise("neutral"))


def role_valence(role: Column) -> Column:
    return F.when(role.isin(*APPROVING, "victim"), "pos").when(role.isin(*CONDEMNING), "neg").otherwise("neu")


def clipped(polarity: Column) -> Column:
    """Polarity held to -2 … 2; a missing one stays missing (least and greatest skip NULLs)."""
    return F.when(polarity.isNotNull(), F.greatest(F.least(polarity, F.lit(2)), F.lit(-2)))


def on_event(records: DataFrame) -> DataFrame:
    return records.filter(F.coalesce("on_event", F.lit(True)))


def labels(records: DataFrame) -> DataFrame:
    return records.select(*EG, "message_id", F.explode("action_labels").alias("a")).select(*EG, "message_id", "a.term", "a.valence")


def mentions(records: DataFrame) -> DataFrame:
    return records.select(*EG, "message_id", "epistemic_status", F.explode("moral_evaluation").alias("m")).select(
        *EG, "message_id", "epistemic_status", "m.entity", "m.role", "m.polarity", "m.intensity")


def group_sizes(records: DataFrame) -> DataFrame:
    return records.groupBy(*EG).agg(n_rows().alias("group_n"))


def canonical_entities(records: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Entity names mapped to canonical ones in every nested field; names are trimmed, the lookup ignores case.

    The alias list is a parameter of a few dozen pairs and travels inside the plan.
    """
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])

    def canon(name: Column) -> Column:
        return F.coalesce(F.element_at(table, F.lower(F.trim(name))), F.trim(name))

    cause = F.col("causal_attribution")
    return (
        records.withColumn("entities", F.transform("entities", lambda e: e.withField("canonical", canon(e["canonical"]))))
        .withColumn("moral_evaluation", F.transform("moral_evaluation", lambda m: m.withField("entity", canon(m["entity"]))))
        .withColumn("causal_attribution", F.when(cause.isNotNull(), cause.withField("cause_entity", canon(cause["cause_entity"])))))


def signature(records: DataFrame) -> Column:
    """A one-line fingerprint of a record; empty parts are left out."""
    terms = F.filter(F.transform("action_labels", lambda a: a["term"]), lambda t: F.coalesce(t != "", F.lit(False)))
    roles = F.transform(F.filter("moral_evaluation", lambda m: F.coalesce(m["entity"] != "", F.lit(False))),
                        lambda m: F.concat(m["entity"], F.lit("="), F.coalesce(m["role"], F.lit("None"))))
    parts = F.concat_ws(
        " | ", F.nullif(F.col("problem_definition"), F.lit("")),
        F.when(F.size(terms) > 0, F.concat(F.lit("labels: "), F.array_join(terms, ", "))),
        F.concat(F.lit("cause: "), F.nullif(F.col("causal_attribution.cause_entity"), F.lit(""))),
        F.when(F.size(roles) > 0, F.concat(F.lit("roles: "), F.array_join(roles, "; "))),
        F.concat(F.lit("epistemic: "), F.col("epistemic_status")))
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("n/a"))


def slim_record() -> list[Column]:
    """The flat view a reader browses: short names, true frames by name, small structs."""
    true_frames = F.array_compact(F.array(*[F.when(F.col(f"semetko.{f}"), f) for f in FRAMES]))
    return [
        F.col("message_id").alias("id"), F.col("media_group").alias("grp"), F.substring("date", 1, 10).alias("date"), F.col("epistemic_status").alias("epi"),
        F.col("on_event").alias("on"), F.coalesce("text_used", F.lit("")).alias("text"), F.col("problem_definition").alias("pd"), F.col("treatment").alias("tr"),
        F.transform("moral_evaluation", lambda m: F.struct(m["entity"].alias("e"), m["role"].alias("r"), m["polarity"].alias("p"), m["intensity"].alias("i"))).alias("me"),
        F.transform("action_labels", lambda a: F.struct(a["term"].alias("t"), a["valence"].alias("v"))).alias("al"),
        true_frames.alias("sem"), F.transform("entities", lambda e: F.struct(e["canonical"].alias("c"), e["type"].alias("t"))).alias("ent")]


# ---------------------------------------------------------------------------- shares and counts
def share_within(counts: DataFrame, keys: Sequence[str], n: str = "n", out: str = "share") -> DataFrame:
    """Counts over the total of their key (counts are already small)."""
    return counts.withColumn(out, F.col(n).cast("double") / F.sum(n).over(Window.partitionBy(*keys)))


def top_within(counts: DataFrame, keys: Sequence[str], name: str, k: int, n: str = "n") -> DataFrame:
    """The k most frequent values per key; ties by name."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(n), name))
    return counts.withColumn("place", place.cast("long")).filter(F.col("place") <= k)


def narrative_counts(records: DataFrame) -> DataFrame:
    return records.filter(F.col("narrative_id").isNotNull()).groupBy(*EG, "narrative_id").agg(n_rows().alias("n"))


def binomial_quantile(n: int, p: float, q: float) -> int:
    """The smallest k with P(X <= k) >= q for X out of n draws of chance p, by summed log-factorials around the mean."""
    if p >= 1.0:
        return n
    spread = int(12 * math.sqrt(n * p * (1 - p))) + 12
    ks = range(max(0, int(n * p) - spread), min(n, int(n * p) + spread) + 1)
    total = 0.0
    for k in ks:
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
        if total >= q:
            return k
    return n


def interval_checks(intervals: DataFrame, counts: DataFrame) -> DataFrame:
    """Each drawn interval beside the exact one. A label's count in a resample is binomial, so the percentiles that the draws aim at are its
    quantiles; `close` tells that both drawn bounds lie within half a standard deviation and one message of them."""
    @F.pandas_udf("struct<exact_lo:double,exact_hi:double>")
    def exact(n: pd.Series, k: pd.Series) -> pd.DataFrame:
        rows = [(binomial_quantile(a, b / a, 0.025) / a, binomial_quantile(a, b / a, 0.975) / a) for a, b in zip(n.tolist(), k.tolist(), strict=True)]
        return pd.DataFrame(rows, columns=["exact_lo", "exact_hi"])
    d = intervals.join(counts.withColumnRenamed("n", "_k"), [*EG, "narrative_id"])
    d = d.withColumn("x", exact("n", "_k")).withColumns({"exact_lo": F.col("x.exact_lo"), "exact_hi": F.col("x.exact_hi")})
    p, n = F.col("_k") / F.col("n"), F.col("n")
    near = F.sqrt(p * (1 - p) / n) / 2 + 1 / n + F.lit(0.0005)                # bounds are given to three digits
    close = (F.abs(F.col("ci_lo") - F.col("exact_lo")) <= near) & (F.abs(F.col("ci_hi") - F.col("exact_hi")) <= near)
    return d.select(*EG, "narrative_id", "n", "share", "exact_lo", "exact_hi", close.alias("close"), "directional_only")


def share_intervals(records: DataFrame, replicates: int = 1000, per_task: int = 100, small: int = 30, seed: int = 0) -> DataFrame:
    """Narrative share per group with a percentile bootstrap interval.

    Resampling n labels with replacement gives multinomial counts, so replicates are drawn from a
    group's narrative counts, never from its messages: the work is replicates × narratives per group
    whatever the group's size. Draws are seeded by group and block.
    """
    counts = narrative_counts(records)
    sizes = group_sizes(records)
    blocks = F.explode(F.sequence(F.lit(0), F.lit((replicates + per_task - 1) // per_task - 1)))
    spread = counts.join(sizes, EG).withColumn("block", blocks)

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("narrative_id")
        event, group, block, n = rows["event"].iloc[0], rows["media_group"].iloc[0], int(rows["block"].iloc[0]), int(rows["group_n"].iloc[0])
        rng = np.random.default_rng(zlib.crc32(f"{seed}|{event}|{group}|{block}".encode()))
        p = rows["n"].to_numpy(dtype=float) / n
        p = np.append(p, max(0.0, 1.0 - p.sum()))
        todo = min(per_task, replicates - block * per_task)
        drawn = rng.multinomial(n, p / p.sum(), size=todo)[:, :-1] / n
        return pd.DataFrame({"event": event, "media_group": group, "narrative_id": np.tile(rows["narrative_id"].to_numpy(), todo), "s": drawn.ravel()})

    drawn = spread.groupBy(*EG, "block").applyInPandas(draw, "event string, media_group string, narrative_id string, s double")
    # One percentile buffer holds `replicates` values.
    interval = drawn.groupBy(*EG, "narrative_id").agg(F.percentile("s", 0.025).alias("lo"), F.percentile("s", 0.975).alias("hi"))
    return counts.join(sizes, EG).join(interval, [*EG, "narrative_id"]).select(
        *EG, "narrative_id", F.col("group_n").alias("n"), F.bround(F.col("n").cast("double") / F.col("group_n"), 3).alias("share"),
        F.bround("lo", 3).alias("ci_lo"), F.bround("hi", 3).alias("ci_hi"), (F.col("group_n") < small).alias("directional_only"))


def group_distances(counts: DataFrame, value: str) -> DataFrame:
    """Jensen–Shannon distance (base 2) between every two groups' distributions over a value, per event.

    Works on shares, one row per group and value; absent values count as 1e-12 in both groups.
    """
    grid = counts.select("event", value).distinct().join(counts.select(*EG).distinct(), "event")
    filled = grid.join(counts.select(*EG, value, "n"), [*EG, value], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(*EG))
    p = filled.withColumn("p", F.col("n").cast("double") / total + 1e-12)
    p = p.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(*EG))).select(*EG, value, "p")
    a = p.select("event", value, F.col("media_group").alias("group_a"), F.col("p").alias("_p"))
    b = p.select("event", value, F.col("media_group").alias("group_b"), F.col("p").alias("_q"))
    m = (F.col("_p") + F.col("_q")) / 2
    part = F.col("_p") * F.log2(F.col("_p") / m) + F.col("_q") * F.log2(F.col("_q") / m)
    pairs = a.join(b, ["event", value]).filter("group_a < group_b")
    return pairs.groupBy("event", "group_a", "group_b").agg(F.sqrt(F.greatest(F.sum(part) / 2, F.lit(0.0))).alias("js_distance"))


def distance_summary(pairs: DataFrame) -> DataFrame:
    """Mean and largest distance of each group to the others."""
    both = pairs.select("event", F.col("group_a").alias("media_group"), "js_distance").unionByName(
        pairs.select("event", F.col("group_b").alias("media_group"), "js_distance"))
    return both.groupBy(*EG).agg(F.avg("js_distance").alias("mean_js_distance"), F.max("js_distance").alias("max_pair_distance"))


def role_contingency(records: DataFrame) -> DataFrame:
    named = mentions(records).filter((F.col("entity") != "") & (F.col("role") != ""))
    counts = named.groupBy(*EG, "entity", "role").agg(n_rows().alias("n"))
    return share_within(counts, [*EG, "entity"], out="share_in_group_entity")


def role_flips(contingency: DataFrame, min_mentions: int = 3) -> DataFrame:
    """Entities whose dominant role differs between groups; opposed when sympathy meets condemnation."""
    dominant = contingency.groupBy(*EG, "entity").agg(F.min_by("role", F.struct(-F.col("n"), F.col("role"))).alias("role"), F.sum("n").alias("support"))
    enough = dominant.filter(F.col("support") >= min_mentions)
    text = F.concat(F.col("media_group"), F.lit(": "), F.col("role"), F.lit(" ("), F.col("support"), F.lit(")"))
    valence = role_valence(F.col("role"))
    flips = enough.groupBy("event", "entity").agg(
        n_rows().alias("n_groups"), F.countDistinct("role").alias("_roles"),
        ((F.count_if(valence == "pos") > 0) & (F.count_if(valence == "neg") > 0)).alias("opposed_contradiction"),
        F.array_join(F.array_sort(F.collect_list(text)), "; ").alias("assignments"))      # one entry per media group
    return flips.filter((F.col("n_groups") >= 2) & (F.col("_roles") >= 2)).drop("_roles")


def entity_presence(records: DataFrame, top: int = 20) -> DataFrame:
    """Share of a group's messages naming each of the event's most named entities (once per message)."""
    seen = records.select(*EG, "message_id", F.explode("entities").alias("e")).select(*EG, "message_id", F.col("e.canonical").alias("entity")).filter(
        F.col("entity") != "").distinct()
    counts = seen.groupBy(*EG, "entity").agg(n_rows().alias("n"))
    best = top_within(counts.groupBy("event", "entity").agg(F.sum("n").alias("n")), ["event"], "entity", top).select("event", "entity")
    grid = best.join(group_sizes(records), "event")
    return grid.join(counts, [*EG, "entity"], "left").select(
        *EG, "entity", F.bround(F.coalesce("n", F.lit(0)).cast("double") / F.col("group_n"), 3).alias("share"))


def top_causes(records: DataFrame, k: int = 6) -> DataFrame:
    cause = records.withColumn("cause_entity", F.col("causal_attribution.cause_entity")).filter(F.col("cause_entity") != "")
    counts = cause.groupBy(*EG, "cause_entity").agg(n_rows().alias("n"))
    return top_within(counts, EG, "cause_entity", k).join(group_sizes(records), EG).select(
        *EG, "cause_entity", "n", "place", F.bround(F.col("n").cast("double") / F.col("group_n"), 3).alias("share"))


def frame_prevalence(records: DataFrame) -> DataFrame:
    wide = records.groupBy(*EG).agg(*[F.avg(F.coalesce(F.col(f"semetko.{f}"), F.lit(False)).cast("int")).alias(f) for f in FRAMES])
    pairs = ", ".join(f"'{f}', {f}" for f in FRAMES)
    return wide.selectExpr(*EG, f"stack({len(FRAMES)}, {pairs}) as (frame, share)").withColumn("share", F.bround("share", 3))


# ---------------------------------------------------------------------------- comparison tables
def dimensions(records: DataFrame, cast_of: Sequence[str] = (), min_group: int = 15, top_causes: int = 5, clusters: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Every aggregatable framing dimension as one long table of counts: event, dimension, unit, category, group.

    `clusters` gives, for a field, the cluster of each message (message_id, cluster); messages without one do not count there.
    Groups below `min_group` messages are left out.
    """
    r = records
    lab, men = labels(r), mentions(r).filter(F.col("role").isNotNull())
    cause = r.select(*EG, F.col("causal_attribution.cause_entity").alias("c")).filter(F.col("c").isNotNull())
    by_cause = cause.groupBy(*EG, "c").agg(n_rows().alias("n"))
    first = top_within(by_cause.groupBy("event", "c").agg(F.sum("n").alias("n")), ["event"], "c", top_causes).select("event", "c", F.lit(True).alias("_top"))
    per_message = [("Epistemic status", F.col("epistemic_status")), ("Prescribes a remedy", F.when(F.col("treatment") != "", "prescribes").otherwise("none"))]
    per_message += [(f"Frame · {f}", F.when(F.col(f"semetko.{f}"), "uses").otherwise("—")) for f in FRAMES]
    message = r.select(*EG, F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.lit("message").alias("unit"), c.alias("category")) for n, c in per_message])).alias("d"))
    parts = [message.select(*EG, "d.*").groupBy(*EG, "dimension", "unit", "category").agg(n_rows().alias("n"))]

    def add(frame: DataFrame, name: str, unit: str, category: Column) -> None:
        parts.append(frame.groupBy(*EG, category.alias("category")).agg(n_rows().alias("n")).select(*EG, F.lit(name).alias("dimension"), F.lit(unit).alias("unit"), "category", "n"))

    add(lab, "Action-label valence", "loaded term", F.col("valence"))
    add(men, "Role type (overall cast)", "role assignment", role_category(F.col("role")))
    for e in cast_of:
        add(men.filter(F.col("entity") == e), f"Cast of: {e}", "role assignment", role_category(F.col("role")))
    for field, labelled in (clusters or {}).items():
        add(r.select(*EG, "message_id").join(labelled, "message_id"), f"{field} cluster", "message", F.concat(F.lit("C"), "cluster"))
    blamed = by_cause.join(first, ["event", "c"], "left").groupBy(*EG, F.when(F.col("_top"), F.col("c")).otherwise("(other)").alias("category")).agg(F.sum("n").alias("n"))
    parts.append(blamed.select(*EG, F.lit("Blamed entity (cause)").alias("dimension"), F.lit("msg w/ cause").alias("unit"), "category", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    big = group_sizes(r).filter(F.col("group_n") >= min_group).select(*EG)
    return out.join(big, EG, "left_semi")


def within_event(records: DataFrame, min_group: int = 15) -> DataFrame:
    """Per event how far groups of 15 messages or more lie apart on each measure, with a plain verdict."""
    big = group_sizes(records).filter(F.col("group_n") >= min_group)
    r = records.join(big.select(*EG), EG, "left_semi")

    def pct(c: Column) -> Column:
        return F.bround(F.avg(c.cast("int")) * 100, 0)

    msg = r.groupBy(*EG).agg(pct(F.col("epistemic_status") == "asserted").alias("own voice"),
                             *[pct(F.coalesce(F.col(f"semetko.{f}"), F.lit(False))).alias(f) for f in ("human_interest", "morality")])
    rates = msg.selectExpr(*EG, "stack(3, 'own voice', `own voice`, 'human interest', human_interest, 'morality', morality) as (measure, value)")
    tone = labels(r).groupBy(*EG).agg(pct(F.col("valence") == "positive").alias("p"))
    tone = big.select(*EG).join(tone, EG, "left").select(*EG, F.lit("positive terms").alias("measure"), F.coalesce("p", F.lit(0.0)).alias("value"))
    named = mentions(records).filter(F.col("entity") != "")
    central = top_within(named.groupBy("event", "entity").agg(n_rows().alias("n")), ["event"], "entity", 4).select("event", "entity")
    stance = named.join(central, ["event", "entity"], "left_semi").join(big.select(*EG), EG, "left_semi").groupBy(*EG, "entity").agg(
        F.avg(clipped(F.col("polarity"))).alias("value"), F.count("polarity").alias("c")).filter("c >= 3").select(
        *EG, F.concat(F.lit("stance: "), F.col("entity")).alias("measure"), "value")
    spread = rates.unionByName(tone).unionByName(stance).groupBy("event", "measure").agg(
        n_rows().alias("groups"), (F.max("value") - F.min("value")).alias("spread")).filter("groups >= 2")
    strong = F.when(F.col("measure").startswith("stance"), 0.7).otherwise(25.0)
    some = F.when(F.col("measure").startswith("stance"), 0.3).otherwise(10.0)
    gap = F.round("spread", 9)
    return spread.withColumn("verdict", F.when(gap >= strong, "STRONG").when(gap >= some, "some").otherwise("little"))


def actor_stance(records: DataFrame, min_mentions: int) -> DataFrame:
    """Mean clipped polarity, two main roles and share quoted per (entity, group), for entities named often enough."""
    m = mentions(records).filter((F.col("entity") != "") & F.col("role").isNotNull() & F.col("polarity").isNotNull())
    roles = m.groupBy(*EG, "entity", "role").agg(n_rows().alias("n"), F.sum(clipped(F.col("polarity"))).alias("p"), F.count_if(F.col("epistemic_status") == "attributed").alias("q"))
    often = roles.groupBy("event", "entity").agg(F.sum("n").alias("_n")).filter(F.col("_n") >= min_mentions).select("event", "entity")
    two = top_within(roles, [*EG, "entity"], "role", 2).groupBy(*EG, "entity").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "role", "n"))), lambda s: F.concat_ws(" ", s["role"], s["n"])), ", ").alias("top_roles"))
    stance = roles.groupBy(*EG, "entity").agg(F.sum("n").alias("n"), F.bround(F.sum("p").cast("double") / F.sum("n"), 2).alias("mean_polarity"),
                                              F.bround(F.sum("q").cast("double") / F.sum("n"), 2).alias("share_quoted"))
    return stance.join(often, ["event", "entity"], "left_semi").join(two, [*EG, "entity"])


def polarity_wide(stance: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One row per entity, one 'mean (n)' cell per group."""
    sign = F.when(F.col("mean_polarity") < 0, "-").otherwise("+")
    cell = F.concat(sign, fixed_point(F.abs("mean_polarity"), 1), F.lit(" ("), F.col("n"), F.lit(")"))
    return stance.groupBy("event", "entity").agg(
        *[F.coalesce(F.max(F.when(F.col("media_group") == g, cell)), F.lit("—")).alias(g) for g in groups], F.sum("n").alias("total_n"))


def share_table(items: DataFrame, sizes: DataFrame, cluster: str) -> DataFrame:
    """Cluster × group: share of messages touching the cluster, share of items in it, spread over groups."""
    counts = items.groupBy(*EG, cluster, "message_id").agg(n_rows().alias("k")).groupBy(*EG, cluster).agg(n_rows().alias("messages"), F.sum("k").alias("items"))
    totals = counts.groupBy(*EG).agg(F.sum("items").alias("all_items"))
    grid = counts.select("event", cluster).distinct().join(sizes, "event")
    full = grid.join(counts, [*EG, cluster], "left").join(totals, EG, "left").select(
        *EG, cluster, (F.coalesce("messages", F.lit(0)).cast("double") / F.col("group_n")).alias("message_share"),
        (F.coalesce("items", F.lit(0)).cast("double") / F.greatest(F.coalesce("all_items", F.lit(0)), F.lit(1))).alias("item_share"))
    w = Window.partitionBy("event", cluster)
    return full.withColumn("spread", F.max("message_share").over(w) - F.min("message_share").over(w))


def cast_matrix(records: DataFrame, min_group: int = 15, top: int = 20, shown: int = 7) -> DataFrame:
    """Main actors × groups: dominant role, a rival second role, mean polarity, and whether the cast is contested."""
    big = group_sizes(records).filter(F.col("group_n") >= min_group).select(*EG)
    named = mentions(records).filter(F.col("entity") != "")
    total = top_within(named.groupBy("event", "entity").agg(n_rows().alias("n")), ["event"], "entity", top).select("event", "entity", F.col("place").alias("_rank"))
    m = named.join(big, EG, "left_semi").join(total, ["event", "entity"])
    pol = m.groupBy(*EG, "entity", "_rank").agg(F.avg(clipped(F.col("polarity"))).alias("mean_polarity"), F.count("polarity").alias("n")).filter("n >= 2")
    ranked = top_within(m.filter(F.col("role") != "").groupBy(*EG, "entity", "role").agg(n_rows().alias("c")), [*EG, "entity"], "role", 2, "c")
    roles = ranked.groupBy(*EG, "entity").agg(
        F.max(F.when(F.col("place") == 1, F.col("role"))).alias("role"), F.max(F.when(F.col("place") == 1, F.col("c"))).alias("_c1"),
        F.max(F.when(F.col("place") == 2, F.col("role"))).alias("_r2"), F.max(F.when(F.col("place") == 2, F.col("c"))).alias("_c2"))
    cells = pol.join(roles, [*EG, "entity"], "left")
    n_groups = big.groupBy("event").agg(n_rows().alias("_g"))
    cover = cells.groupBy("event", "entity", "_rank").agg(n_rows().alias("_cov")).join(n_groups, "event").filter(F.col("_cov") >= F.greatest(F.lit(3), F.floor(F.col("_g") / 2)))
    kept = cover.withColumn("_p", F.row_number().over(Window.partitionBy("event").orderBy("_rank"))).filter(F.col("_p") <= shown).select("event", "entity")
    cells = cells.join(kept, ["event", "entity"], "left_semi").withColumn("_cat", role_category(F.col("role")))
    cats = F.collect_set(F.when(F.col("_cat") != "neutral", F.col("_cat"))).over(Window.partitionBy("event", "entity"))
    rival = (F.col("_c2") >= F.col("_c1") * 0.6) & (role_category(F.col("_r2")) != F.col("_cat"))
    return cells.select(*EG, "entity", "role", F.when(rival, F.col("_r2")).alias("second_role"), "mean_polarity", "n", (F.size(cats) >= 2).alias("contested"))


def roles_to_actors(records: DataFrame) -> DataFrame:
    """Who filled each role: its three most frequent actors, roles ordered by category and use."""
    named = mentions(records).filter((F.col("role") != "") & (F.col("entity") != ""))
    counts = named.groupBy("event", "role", "entity").agg(n_rows().alias("n"))
    three = top_within(counts, ["event", "role"], "entity", 3).groupBy("event", "role").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "entity"))), lambda s: s["entity"]), ", ").alias("actors"))
    uses = counts.groupBy("event", "role").agg(F.sum("n").alias("uses"))
    category = role_category(F.col("role"))
    order = F.array_position(F.array(*[F.lit(c) for c in ("favourable", "victim", "unfavourable", "neutral")]), F.col("category"))
    place = F.row_number().over(Window.partitionBy("event").orderBy(order, F.desc("uses"), "role"))
    return uses.join(three, ["event", "role"]).withColumn("category", category).withColumn("place", place.cast("long"))


def blame_and_remedy(records: DataFrame, typical: DataFrame) -> DataFrame:
    """Two main causes, how many messages prescribe a remedy, and the typical remedy (from `typical`: event, group, phrase)."""
    two = top_causes(records, 2).groupBy(*EG).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "cause_entity", "n"))), lambda s: F.concat_ws(" ", s["cause_entity"], s["n"])), ", ").alias("blames"))
    base = records.groupBy(*EG).agg(F.count_if(F.col("treatment") != "").alias("prescribing"), n_rows().alias("messages"))
    return base.join(two, EG, "left").join(typical.select(*EG, F.col("phrase").alias("remedy")), EG, "left")


def scorecard(records: DataFrame) -> DataFrame:
    """How the instrument behaves per event: coverage, dead roles, null rates, values out of range, means per message."""
    def nested(name: str, keep) -> Column:
        return F.size(F.filter(name, keep))
    r = records
    flat = r.groupBy("event").agg(
        n_rows().alias("messages"), F.count_if(~F.coalesce("on_event", F.lit(True))).alias("off_event"),
        F.avg((F.size("moral_evaluation") > 0).cast("int")).alias("role_coverage"),
        F.avg(F.col("causal_attribution.cause_entity").isNull().cast("int")).alias("causal_null"), F.avg(F.col("treatment").isNull().cast("int")).alias("treatment_null"),
        F.sum(nested("moral_evaluation", lambda m: ~m["polarity"].between(-2, 2))).alias("polarity_out_of_range"),
        F.sum(nested("moral_evaluation", lambda m: ~m["intensity"].between(0, 2))).alias("intensity_out_of_range"),
        F.sum(F.size("moral_evaluation")).alias("role_assignments"),
        F.sum(nested("moral_evaluation", lambda m: m["role"].isin("other", "neutral_actor"))).alias("_vague"),
        F.avg(F.size("entities")).alias("entities_per_message"), F.avg(F.size("action_labels")).alias("labels_per_message"),
        F.sum(nested("action_labels", lambda a: a["valence"] == "positive")).alias("positive_labels"),
        F.sum(nested("action_labels", lambda a: a["valence"] == "negative")).alias("negative_labels"))
    used = mentions(r).select("event", "role").distinct().filter(F.col("role").isin(*ROLES)).groupBy("event").agg(n_rows().alias("_used"))
    kinds = r.select("event", F.explode("entities").alias("e")).select("event", F.lower(F.trim("e.type")).alias("t")).filter("t <> ''").distinct().groupBy("event").agg(
        n_rows().alias("entity_types"))
    return flat.join(used, "event", "left").join(kinds, "event", "left").withColumn("dead_roles", F.lit(len(ROLES)) - F.coalesce("_used", F.lit(0))).withColumn(
        "vague_share", F.col("_vague").cast("double") / F.nullif(F.col("role_assignments"), F.lit(0))).drop("_used", "_vague")


def group_metrics(records: DataFrame) -> DataFrame:
    """Message- and label-level shares per event and group."""
    status = F.col("epistemic_status")

    def share(c: Column) -> Column:
        return F.avg(F.coalesce(c, F.lit(False)).cast("int"))

    def with_valence(value: str | None = None) -> Column:
        return F.sum(F.size(F.filter("action_labels", lambda a: (a["valence"] == value) if value else (a["valence"] != ""))))

    base = records.groupBy(*EG).agg(
        n_rows().alias("n_messages"), share(status == "asserted").alias("asserted_share"), share(status == "attributed").alias("attributed_share"),
        share(status.isin("hedged", "questioned", "denied")).alias("hedged_or_questioned_share"), share(F.col("treatment") != "").alias("treatment_present_share"),
        *[share(F.col(f"semetko.{f}")).alias(f"{f}_share") for f in FRAMES], with_valence().alias("n_action_labels"),
        *[with_valence(v).alias(f"_{v}") for v in ("positive", "negative", "neutral")])
    for v in ("positive", "negative", "neutral"):
        base = base.withColumn(f"{v}_action_label_share", F.col(f"_{v}").cast("double") / F.nullif(F.col("n_action_labels"), F.lit(0))).drop(f"_{v}")
    return base


def actor_metrics(records: DataFrame, actors: Sequence[str]) -> DataFrame:
    """Mean clipped polarity per actor and group: over all mentions and over those in the outlet's own voice."""
    m = mentions(records).filter(F.col("entity").isin(*actors) & F.col("polarity").isNotNull())
    p, own = clipped(F.col("polarity")), F.col("epistemic_status") == "asserted"
    return m.groupBy(*EG, F.col("entity").alias("actor")).agg(
        n_rows().alias("n_role_assignments"), F.avg(p).alias("mean_polarity_all_mentions"), F.count_if(own).alias("n_asserted_role_assignments"),
        F.avg(F.when(own, p)).alias("mean_polarity_asserted_only"))


def spread_table(metrics: DataFrame, min_group: int = 15, min_labels: int = 20) -> DataFrame:
    """Highest against lowest group per dimension, in points (one row per event, group and dimension before)."""
    shares = [c for c in metrics.columns if c.endswith("_share") and "action_label" not in c]
    pairs = ", ".join(f"'{c}', n_messages, {c}" for c in shares)
    message = metrics.filter(F.col("n_messages") >= min_group).selectExpr(*EG, f"stack({len(shares)}, {pairs}) as (dimension, n, value)")
    labelled = metrics.filter((F.col("n_messages") >= min_group) & (F.col("n_action_labels") >= min_labels)).select(
        *EG, F.lit("positive_action_label_share").alias("dimension"), F.col("n_action_labels").alias("n"), F.col("positive_action_label_share").alias("value"))
    rows = message.unionByName(labelled).filter(F.col("value").isNotNull())
    high = F.max_by(F.struct("media_group", "value", "n"), F.struct(F.round("value", 12), F.col("media_group"))).alias("h")
    low = F.min_by(F.struct("media_group", "value", "n"), F.struct(F.round("value", 12), F.col("media_group"))).alias("l")
    return rows.groupBy("event", "dimension").agg(n_rows().alias("groups_compared"), high, low).filter("groups_compared >= 2").select(
        "event", "dimension", "groups_compared", F.col("h.media_group").alias("high_group"), F.col("h.value").alias("high_value"), F.col("h.n").alias("high_n"),
        F.col("l.media_group").alias("low_group"), F.col("l.value").alias("low_value"), F.col("l.n").alias("low_n"),
        ((F.col("h.value") - F.col("l.value")) * 100).alias("spread_pp"))


def inventory(sets: DataFrame, records: DataFrame, rerun_suffix: str = "_rerun", archived_suffix: str = "_archived", min_group: int = 15) -> DataFrame:
    """Every matched set with its framing status and how many groups are large enough to read."""
    sizes = group_sizes(records).groupBy("event").agg(
        F.sum("group_n").alias("framed_on_event"), F.count_if(F.col("group_n") >= min_group).alias("groups_n_ge_15"), n_rows().alias("groups_total"))
    slug = F.col("event")
    status = (F.when(F.col("framed_on_event").isNotNull(), "framed").when(slug.endswith(rerun_suffix), "retrieval rerun only")
              .when(slug.endswith(archived_suffix), "archived").otherwise("dataset only"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("framed_on_event", "groups_n_ge_15", "groups_total")]
    return sets.join(sizes, "event", "left").select("event", "kept", status.alias("framing_status"), *zero)


def assign_narratives(records: DataFrame, assignments: DataFrame, taxonomy: DataFrame, fallback: str = "other_mixed") -> DataFrame:
    """A narrative for every message: its assigned id if the taxonomy has it, else the fallback.

    The fallback is `other_mixed` where the taxonomy lists it, else the taxonomy's first id.
    """
    known = taxonomy.select(F.col("narrative_id").alias("_id"), F.lit(True).alias("_known"))
    default = taxonomy.agg(F.coalesce(F.max(F.when(F.col("narrative_id") == fallback, F.col("narrative_id"))), F.min_by("narrative_id", "position")).alias("_default"))
    joined = records.select("event", "message_id").join(assignments, ["event", "message_id"], "left").join(known, F.col("narrative_id") == F.col("_id"), "left")
    return joined.crossJoin(F.broadcast(default)).select(   # one row
        "event", "message_id", F.when(F.col("_known"), F.col("narrative_id")).otherwise(F.col("_default")).alias("narrative_id"))


# ---------------------------------------------------------------------------- evidence
def evidence_fields() -> Column:
    """All evidence quotes of a record with their fields, empty ones too, as one array."""
    def one(path: str, value: Column) -> Column:
        return F.struct(F.lit(path).alias("field"), value.alias("span"))
    fixed = F.array(*[one(p, F.col(p)) for p in ("on_event_evidence", "problem_definition_evidence", "epistemic_evidence")],
                    one("causal_attribution.evidence", F.col("causal_attribution.evidence")))

    def many(name: str) -> Column:
        return F.transform(name, lambda x, i: F.struct(F.concat(F.lit(name + "["), i, F.lit("].evidence")).alias("field"), x["evidence"].alias("span")))
    return F.concat(fixed, F.coalesce(many("action_labels"), F.array()), F.coalesce(many("moral_evaluation"), F.array()))


def evidence_spans(records: DataFrame) -> DataFrame:
    """Every non-empty evidence quote of a record with its field."""
    return records.select("event", "message_id", "text_used", F.explode(evidence_fields()).alias("s")).select(
        "event", "message_id", "text_used", "s.*").filter(F.trim("span") != "")


def plain_words(text: Column) -> Column:
    """Lower case, punctuation as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def normal_form(text: str) -> Column:
    """NFKC, then plain words."""
    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x) if x else x)

    return plain_words(nfkc(F.col(text)))


def grounded(text: Column, span: Column, threshold: float = 0.85, shortest: int = 6) -> Column:
    """Whether a quote is in its text: whole, or as one common block of 85 % of its length.

    A common block that long exists exactly when some piece of ceil(0.85 n) characters of the quote is
    in the text.
    """
    n = F.length(span)
    piece = F.ceil(n * threshold).cast("int")
    starts = F.sequence(F.lit(1), F.greatest(n - piece + 1, F.lit(1)))
    return (n < shortest) | F.contains(text, span) | F.exists(starts, lambda i: F.contains(text, F.substring(span, i, piece)))


def provenance(records: DataFrame) -> DataFrame:
    """Per record the share of its evidence quotes that its text holds; after NFKC and without case and punctuation.

    Text and quotes stay together in the record's row as one array, so no text is repeated per quote or shuffled.
    """
    @F.pandas_udf("array<string>")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda xs: [unicodedata.normalize("NFKC", x) if x else x for x in xs])

    spans = F.filter(F.transform(evidence_fields(), lambda s: s["span"]), lambda s: F.trim(s) != "")
    quoted = records.select("event", "message_id", "text_used", spans.alias("_q")).filter(F.size("_q") > 0)                # before the Python step, which then runs once
    words = quoted.select("event", "message_id", F.transform(nfkc(F.concat(F.array("text_used"), "_q")), plain_words).alias("_w"))
    split = words.select("event", "message_id", F.element_at("_w", 1).alias("_t"), F.slice("_w", F.lit(2), F.size("_w")).alias("_s"))
    found = split.select("event", "message_id", F.size("_s").alias("_n"), F.size(F.filter("_s", lambda s: grounded(F.col("_t"), s))).alias("_f"))
    return found.groupBy("event", "message_id").agg(F.sum("_n").alias("n_total"), F.sum("_f").alias("n_found")).withColumn(
        "score", F.col("n_found").cast("double") / F.col("n_total"))
