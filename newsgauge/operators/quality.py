"""Data checks: each returns the rows that break a rule, so an empty result is a pass."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.functions import wording as W

from newsgauge.operators.vocabulary import TERM


def scoped(df: DataFrame, where: str | None) -> DataFrame:
    return df.filter(where) if where else df


def with_severity(violations: DataFrame, severity: str = "error") -> DataFrame:
    """Mark a check as failing or only warning."""
    return violations.withColumn("severity", F.lit(severity))


def unique(df: DataFrame, columns: Sequence[str], where: str | None = None) -> DataFrame:
    return scoped(df, where).groupBy(*columns).agg(F.count(F.lit(1)).alias("rows_found")).filter("rows_found > 1")


def not_null(df: DataFrame, column: str, where: str | None = None) -> DataFrame:
    return scoped(df, where).filter(F.col(column).isNull())


def accepted_values(df: DataFrame, column: str, values: Sequence[object], where: str | None = None) -> DataFrame:
    """Values outside the list with how often they occur; missing values pass."""
    bad = scoped(df, where).filter(F.col(column).isNotNull() & ~F.col(column).isin(*values))
    return bad.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows_found"))


def relationships(df: DataFrame, column: str, parent: DataFrame, parent_column: str, where: str | None = None) -> DataFrame:
    """Values without a parent row, each with how often it occurs."""
    values = scoped(df, where).filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows_found"))
    return values.join(parent.select(F.col(parent_column).alias("value")), "value", "left_anti")


def coverage_within_activity(coverage: DataFrame) -> DataFrame:
    bad = (F.col("matched_posts") > F.col("posts_published_in_window")) | (F.col("sources_covering") > F.col("sources_active"))
    return coverage.filter(bad).select("event_id", "media_group", "matched_posts", "posts_published_in_window", "sources_covering", "sources_active")


def inside_window(messages: DataFrame) -> DataFrame:
    day = F.col("published_date")
    return messages.filter((day < F.col("match_start")) | (day >= F.col("match_end_exclusive"))).select(
        "event_id", "event_slug", "source_name", "message_id", "published_date", "match_start", "match_end_exclusive")


def manifests_reconciled(datasets: DataFrame, counted: DataFrame) -> DataFrame:
    """Events whose counted posts differ from what their manifest says should be there."""
    both = datasets.select("event_id", "matched_posts_expected").join(counted.select("event_id", "matched_posts"), "event_id", "full")
    return both.filter(~F.col("matched_posts_expected").eqNullSafe(F.col("matched_posts")))


def _off_one(total: Column) -> Column:
    return F.abs(total - 1.0) > 0.000001


def baselines_consistent(resonance: DataFrame) -> DataFrame:
    usual = resonance.groupBy("media_group").agg(F.any_value("baseline_share_of_voice").alias("b")).agg(F.sum("b").alias("total")).select(
        F.lit("baseline shares").alias("which"), "total")
    events = resonance.groupBy("event_id").agg(F.sum("share_of_voice").alias("total")).select(F.concat(F.lit("event "), "event_id").alias("which"), "total")
    return usual.unionByName(events).filter(_off_one(F.col("total")))


def share_in_range(overview: DataFrame) -> DataFrame:
    share = F.col("searchable_share_of_window")
    return overview.filter((share < 0) | (share > 1)).select("event_id", "event_slug", share)


def voice_adds_up(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("event_id").agg(F.sum("share_of_voice").alias("total_share")).filter(_off_one(F.col("total_share")))


def one_term_per_fingerprint(forms: DataFrame) -> DataFrame:
    """64-bit term fingerprints standing for more than one term."""
    terms = forms.select(*TERM).distinct().select(F.xxhash64(*TERM).alias("term_hash"), F.concat_ws(" ", *TERM).alias("t"))
    return terms.groupBy("term_hash").agg(F.min("t").alias("first"), F.max("t").alias("last")).filter(F.col("first") != F.col("last"))


def lists_match_counts(kept: DataFrame, lists: DataFrame) -> DataFrame:
    key = ["event_id", "media_group", *TERM]
    sizes = lists.groupBy(*key).agg(F.sum(F.size("post_keys")).alias("posts_in_list"))
    return kept.join(sizes, key, "left").filter(~F.col("posts_with_term").eqNullSafe(F.col("posts_in_list"))).select(*key, "posts_with_term", "posts_in_list")


def not_one_channels_habit(kept: DataFrame) -> DataFrame:
    few = F.col("sources_with_term") < F.least(F.lit(2), F.col("group_sources"))
    one = (F.col("sources_with_term") >= 3) & (F.col("top_source_share_of_term") > 0.7)
    return kept.filter(few | one).select("event_id", "media_group", *TERM, "sources_with_term", "top_source_share_of_term")


def each_post_once(theme_coverage: DataFrame, detail: DataFrame) -> DataFrame:
    """Total over everything against the number of distinct posts (two one-row results side by side)."""
    rolled = theme_coverage.filter("scope_type = 'all'").agg(F.sum("distinct_matched_posts").alias("rolled_up_posts"))
    distinct = detail.select("source_name", "message_id").distinct().agg(F.count(F.lit(1)).alias("distinct_posts"))
    return rolled.crossJoin(F.broadcast(distinct)).filter("rolled_up_posts <> distinct_posts")


def single_event_equal(week_events: DataFrame, datasets: DataFrame, theme_coverage: DataFrame, coverage: DataFrame) -> DataFrame:
    """Scopes with one searched event whose figures are not that event's."""
    searched = week_events.join(datasets.select("event_id"), "event_id", "left_semi")
    scopes = searched.select(F.lit("theme").alias("scope_type"), F.col("theme_id").alias("scope_id"), "event_id").unionByName(
        searched.select(F.lit("umbrella").alias("scope_type"), F.col("umbrella_id").alias("scope_id"), "event_id")).filter("scope_id is not null")
    single = scopes.groupBy("scope_type", "scope_id").agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    rolled = theme_coverage.join(single, ["scope_type", "scope_id"]).select("event_id", "media_group", "distinct_matched_posts", "posts_published_in_union_window", F.lit(1).alias("_a"))
    own = coverage.join(single.select("event_id").distinct(), "event_id", "left_semi").select("event_id", "media_group", "matched_posts", "posts_published_in_window", F.lit(1).alias("_b"))
    both = rolled.join(own, ["event_id", "media_group"], "full")
    bad = (F.col("_a").isNull() | F.col("_b").isNull() | (F.col("distinct_matched_posts") != F.col("matched_posts"))
           | (F.col("posts_published_in_union_window") != F.col("posts_published_in_window")))
    return both.filter(bad).drop("_a", "_b")


def overrides_match(overrides: DataFrame, survey: DataFrame) -> DataFrame:
    key = ["survey_year", "survey_week", "event_name"]
    return overrides.join(survey.select(*key), key, "left_anti")


def theme_weeks_unique(attention: DataFrame, theme_coverage: DataFrame) -> DataFrame:
    a = attention.groupBy(F.lit("theme_week_attention").alias("model"), F.col("theme_id").alias("scope_id"), F.col("week_start").cast("string").alias("part")).agg(
        F.count(F.lit(1)).alias("rows_found"))
    b = theme_coverage.groupBy(F.lit("theme_group_coverage").alias("model"), F.concat_ws(":", "scope_type", "scope_id").alias("scope_id"), F.col("media_group").alias("part")).agg(
        F.count(F.lit(1)).alias("rows_found"))
    return a.unionByName(b).filter("rows_found > 1")


def nonstandard_settings(overview: DataFrame) -> DataFrame:
    """Events whose counts cannot be compared with the others', with the reason (a warning)."""
    low, thin = ~F.col("standard_relevance_cutoff"), F.col("searchable_share_of_window") < 0.9
    reason = F.when(low & thin, W.LOOSE_AND_PART).when(low, W.LOOSE_ONLY).otherwise(W.PART_ONLY)
    return with_severity(overview.filter(low | thin).select(
        "event_slug", "retriever", "rerank_threshold", "matched_posts", "searchable_posts_in_window", "posts_published_in_window",
        F.round("searchable_share_of_window", 3).alias("searchable_share_of_window"), reason.alias("reason")), "warn")


def theme_for_every_event(events: DataFrame) -> DataFrame:
    """Specific events without a theme (a warning)."""
    return with_severity(not_null(events, "theme_id", "event_kind = 'specific event'").select("event_id", "event_name"), "warn")
