"""Survey and theme marts: which subjects people named week by week, and how they were covered."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.functions.dates import iso_year, window_days
from newsgauge.session import summary


def events_with_themes(events: DataFrame, wording_themes: DataFrame, overrides: DataFrame, themes: DataFrame) -> DataFrame:
    """Survey rows with their theme: by wording for specific events, with exact weeks overridden."""
    default = wording_themes.select("event_name", F.col("theme_id").alias("_default"))
    exact = overrides.select("survey_year", "survey_week", "event_name", F.col("theme_id").alias("_exact"))
    specific = F.col("event_kind") == "specific event"
    return (
        events.join(default, "event_name", "left").join(exact, ["survey_year", "survey_week", "event_name"], "left")
        .withColumn("theme_id", F.coalesce("_exact", F.when(specific, F.col("_default"))))
        .drop("_default", "_exact")
        .join(themes.select("theme_id", "theme_label", "umbrella_id", "umbrella_label", "theme_order", "umbrella_order"),
              "theme_id", "left")
    )


def week_events(themed: DataFrame, overview: DataFrame, labels: DataFrame, empty_searches: DataFrame) -> DataFrame:
    """Every row of every survey list with rank, theme and one of three coverage answers."""
    built = overview.select("event_id", F.col("event_slug").alias("_built_slug"), "matched_posts", "groups_covering",
                            "groups_active", F.lit(True).alias("_built"))
    empty = empty_searches.select("event_id", F.col("event_slug").alias("_empty_slug"), F.lit(True).alias("_empty"))
    specific = F.col("event_kind") == "specific event"
    order = Window.partitionBy("week_start", specific).orderBy(F.col("attention_percentage").desc_nulls_last(), "event_name")
    status = (
        F.when(F.col("_built") & (F.coalesce("matched_posts", F.lit(0)) > 0), "measured")
        .when(F.col("_built") | F.col("_empty"), "no post passed the cut-off").otherwise("not measured"))
    return (
        themed.withColumn("rank_in_week", F.when(specific, F.row_number().over(order)).cast("long"))
        .join(built, "event_id", "left").join(empty, "event_id", "left")
        .join(labels.select(F.col("event_slug").alias("_built_slug"), "label_en"), "_built_slug", "left")
        .select(
            "event_id", "survey_year", "survey_week", "week_start", "week_end", "event_name", "event_kind",
            "attention_percentage", "quote_examples", "rank_in_week", "theme_id", "theme_label", "umbrella_id",
            "umbrella_label", status.alias("coverage_status"), F.coalesce("_built_slug", "_empty_slug").alias("event_slug"),
            F.col("label_en").alias("event_label_en"), "matched_posts", "groups_covering", "groups_active")
    )


def survey_weeks(events: DataFrame) -> DataFrame:
    """The calendar from the first survey week to the last; weeks without a survey are rows too."""
    calendar = events.agg(F.min("week_start").alias("a"), F.max("week_start").alias("b")).select(
        F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("week_start"))
    per_week = events.groupBy("week_start").agg(
        F.count_if(F.col("event_kind") == "specific event").alias("n_s"),
        F.count_if(F.col("coverage_status") == "measured").alias("n_m"),
        F.max(F.when(F.col("event_kind") == "survey non-response", F.col("attention_percentage"))).alias("non_response_percentage"),
        F.lit(True).alias("_has"))
    return calendar.join(per_week, "week_start", "left").select(
        "week_start", F.date_add("week_start", 6).alias("week_end"), iso_year(F.col("week_start")).alias("survey_year"),
        F.weekofyear("week_start").alias("survey_week"), F.coalesce("_has", F.lit(False)).alias("has_survey"),
        F.coalesce("n_s", F.lit(0)).alias("n_specific_events"), F.coalesce("n_m", F.lit(0)).alias("n_measured_events"),
        "non_response_percentage")


def theme_week_attention(events: DataFrame, themes: DataFrame) -> DataFrame:
    """Mentions per theme and week with the top event and how many share its place."""
    share = F.col("attention_percentage")
    named = events.filter((F.col("event_kind") == "specific event") & F.col("theme_id").isNotNull())
    top = F.max(share).over(Window.partitionBy("theme_id", "week_start"))
    first = F.struct(F.when(share.isNull(), 1).otherwise(0), -share, F.col("event_name"))
    per = named.withColumn("_top", top).groupBy("theme_id", "week_start").agg(
        F.min("survey_year").alias("survey_year"), F.min("survey_week").alias("survey_week"),
        F.sum(share).alias("attention_sum"), F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("coverage_status") == "measured").alias("n_measured_events"),
        F.min_by("event_name", first).alias("top_event_name"), F.max(share).alias("top_event_share"),
        F.count_if(share == F.col("_top")).alias("n_top_events"))
    return per.join(themes, "theme_id").select(
        "umbrella_id", "umbrella_label", "umbrella_order", "theme_id", "theme_label", "theme_order", "is_other_theme",
        "week_start", "survey_year", "survey_week", "attention_sum", "n_events", "top_event_name", "top_event_share",
        "n_top_events", "n_measured_events")


def scope_events(events: DataFrame) -> DataFrame:
    """Each specific event in its theme, its umbrella and in everything."""
    specific = events.filter(F.col("event_kind") == "specific event")
    scope = F.explode(F.array(
        F.struct(F.lit("theme").alias("scope_type"), F.col("theme_id").alias("scope_id")),
        F.struct(F.lit("umbrella").alias("scope_type"), F.col("umbrella_id").alias("scope_id")),
        F.struct(F.lit("all").alias("scope_type"), F.lit("all").alias("scope_id"))))
    return specific.select("event_id", "coverage_status", scope.alias("s")).select(
        "s.scope_type", "s.scope_id", "event_id", "coverage_status").filter(F.col("scope_id").isNotNull())


def theme_group_coverage(events: DataFrame, datasets: DataFrame, activity: DataFrame, groups: DataFrame,
                         messages: DataFrame) -> DataFrame:
    """Coverage summed over a scope's events: each post once, each calendar day once."""
    scope = ["scope_type", "scope_id"]
    scoped = scope_events(events)
    counts = scoped.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("coverage_status") == "measured").alias("n_measured_events"))
    # Scopes' events and days are written, so that they go to every task while they are small, as they mostly are.
    measured = summary(scoped.select(*scope, "event_id").join(datasets.select("event_id", "match_start", "match_end_exclusive"), "event_id"))
    days = summary(measured.select(*scope, window_days(F.col("match_start"), F.col("match_end_exclusive")).alias("activity_date")).distinct())
    length = days.groupBy(*scope).agg(F.count(F.lit(1)).alias("union_window_days"))
    # Days of a source are together before they meet the scopes: a source has one row per day, and the sums need no second shuffle.
    published = (
        activity.repartition("source_name").join(days, "activity_date")
        .groupBy(*scope, "source_name").agg(F.sum("post_count").alias("p"))
        .join(groups.select("source_name", "media_group", "media_group_key"), "source_name")
        .groupBy(*scope, "media_group", "media_group_key")
        .agg(F.count(F.lit(1)).alias("sources_active"), F.sum("p").alias("posts_published_in_union_window")))
    # A post counts once per scope: its rows are brought together before they meet the scopes and told apart there, spread over (source, post); counts after.
    once = messages.select("event_id", "media_group", "source_name", "message_id").repartition("source_name", "message_id").join(
        measured.select(*scope, "event_id"), "event_id").select(
        *scope, "media_group", "source_name", "message_id").distinct()
    matched = (
        once.groupBy(*scope, "media_group", "source_name").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*scope, "media_group").agg(F.sum("n").alias("d"), F.count(F.lit(1)).alias("s")))
    posts, out = F.coalesce("d", F.lit(0)), F.col("posts_published_in_union_window")
    return (
        published.join(counts, scope).join(length, scope).join(matched, scope + ["media_group"], "left")
        .select(*scope, "media_group", "media_group_key", "n_events", "n_measured_events", posts.alias("distinct_matched_posts"),
                F.coalesce("s", F.lit(0)).alias("sources_covering"), "sources_active", "union_window_days", out.alias("posts_published_in_union_window"),
                F.when(out > 0, posts * F.lit(1000.0).cast("double") / out).alias("matched_posts_per_1000_published"))
    )
