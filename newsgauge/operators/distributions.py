"""Every framing field by group in one long table of shares and means."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.operators.framing import EG, FRAMES, clipped, labels, mentions, share_within, top_within


def all_fields(records: DataFrame, actors: int = 6, min_mentions: int = 3) -> DataFrame:
    """(event, group, field, value, share): statuses, valences, roles, stance, intensity, frames, remedy, cause, entities."""
    def shares(frame: DataFrame, field: str, column: str) -> DataFrame:
        counts = frame.groupBy(*EG, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        return share_within(counts, EG).select(*EG, F.lit(field).alias("field"), "value", "share")

    def rate(c: Column) -> Column:
        return F.avg(F.coalesce(c, F.lit(False)).cast("int"))

    men = mentions(records)
    named = men.filter(F.col("entity") != "")
    top = top_within(named.groupBy("event", "entity").agg(F.count(F.lit(1)).alias("n")), ["event"], "entity", actors).select("event", "entity")
    stance = named.join(top, ["event", "entity"], "left_semi").groupBy(*EG, F.col("entity").alias("value")).agg(
        F.avg(clipped(F.col("polarity"))).alias("share"), F.count("polarity").alias("c")).filter(F.col("c") >= min_mentions).select(
        *EG, F.lit("stance").alias("field"), "value", "share")
    intensity = men.groupBy(*EG).agg(F.avg("intensity").alias("share")).select(*EG, F.lit("intensity").alias("field"), F.lit("mean").alias("value"), "share")
    wide = records.groupBy(*EG).agg(
        *[rate(F.col(f"semetko.{f}")).alias(f) for f in FRAMES], rate(F.col("treatment") != "").alias("remedy"),
        rate(F.col("causal_attribution.cause_entity") != "").alias("cause"), F.avg(F.size("entities")).alias("entities"))
    rows = [f"'frame', '{f}', {f}" for f in FRAMES] + ["'remedy', 'prescribes', remedy", "'cause', 'named', cause", "'entities', 'per message', entities"]
    per_message = wide.selectExpr(*EG, f"stack({len(rows)}, {', '.join(rows)}) as (field, value, share)")
    out = shares(records, "epistemic", "epistemic_status")
    for part in (shares(labels(records), "valence", "valence"), shares(men, "role", "role"), stance, intensity, per_message):
        out = out.unionByName(part)
    return out
