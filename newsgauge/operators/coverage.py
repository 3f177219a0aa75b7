"""Coverage marts: who published, who matched, how much, how early and how far it reached.

Posts are the large side everywhere. They are grouped once, map-side first, to small
(event, source, day) figures, and every mart above works on those figures.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.functions.dates import hours_between, iso_week_monday, window_days
from newsgauge.functions.text import event_fingerprint, json_message
from newsgauge.operators.scaling import exact_median, percent_ranks
from newsgauge.session import summary

UNKNOWN_GROUP = "Ungrouped source (unexpected)"
UNKNOWN_GROUP_KEY = "ungrouped_unexpected"
LAST = Window.unboundedPreceding


def stage_survey(raw: DataFrame, non_response: list[str], catch_all: list[str],
                 days_before: int = 3, days_after: int = 10) -> DataFrame:
    """Survey rows with their key, ISO-week window and kind; no row is dropped."""
    monday = iso_week_monday(F.col("year"), F.col("week"))
    name = F.trim("event")
    kind = (
        F.when(name.isin(*non_response), "survey non-response")
        .when(name.isin(*catch_all), "catch-all category").otherwise("specific event")
    )
    return raw.select(
        event_fingerprint(F.col("year"), F.col("week"), F.col("event")).alias("event_id"),
        F.col("year").cast("int").alias("survey_year"), F.col("week").cast("int").alias("survey_week"),
        name.alias("event_name"), F.col("description").alias("quote_examples"),
        F.col("percentage").alias("attention_percentage"),
        monday.alias("week_start"), F.date_add(monday, 6).alias("week_end"),
        F.date_sub(monday, days_before).alias("match_start"),
        F.date_add(monday, days_after + 7).alias("match_end_exclusive"),
        kind.alias("event_kind"),
    )


def source_activity(posts: DataFrame, archived: DataFrame | None = None) -> DataFrame:
    """Posts per source and day, the denominator; archived sources and undated posts are left out."""
    per_day = posts.filter(F.col("published_at").isNotNull()).groupBy("source_name", F.to_date("published_at").alias("activity_date")).agg(
        F.count(F.lit(1)).alias("post_count"))
    return per_day if archived is None else per_day.join(archived.select("source_name"), "source_name", "left_anti")


def corpus_day_posts(posts: DataFrame) -> DataFrame:
    """Posts per day over every source, archived ones included."""
    return posts.filter(F.col("published_at").isNotNull()).groupBy(F.to_date("published_at").alias("day")).agg(
        F.count(F.lit(1)).alias("posts"))


def window_totals(windows: DataFrame, days: DataFrame) -> DataFrame:
    """Posts in each event's window; the window is a short list of days, so this is an equi join."""
    spread = windows.select("event_id", window_days(F.col("match_start"), F.col("match_end_exclusive")).alias("day"))
    return spread.join(days, "day").groupBy("event_id").agg(F.sum("posts").alias("posts_in_window_all_sources"))


def event_messages(matches: DataFrame, datasets: DataFrame, groups: DataFrame) -> DataFrame:
    """Matched posts with their event, their media group and where they sit in the window."""
    ev = datasets.select("event_id", "event_name", "survey_year", "survey_week", "attention_percentage",
                         "match_start", "match_end_exclusive")
    gr = groups.select("source_name", "media_group", "media_group_key")
    return (
        matches.join(ev, "event_id").join(gr, "source_name", "left")
        .withColumn("media_group", F.coalesce("media_group", F.lit(UNKNOWN_GROUP)))
        .withColumn("media_group_key", F.coalesce("media_group_key", F.lit(UNKNOWN_GROUP_KEY)))
        .withColumn("hours_from_window_start", hours_between(F.col("match_start"), F.col("published_at")))
        .withColumn("days_from_window_start", F.datediff("published_date", "match_start").cast("long"))
    )


def message_days(messages: DataFrame) -> DataFrame:
    """The one grouping of posts the marts share: event, group, source, day."""
    return messages.groupBy("event_id", "media_group", "source_name", "published_date").agg(
        F.count(F.lit(1)).alias("posts"),
        F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"),
        F.sum("views").alias("views"), F.sum("forwards").alias("forwards"),
        F.count_if(F.col("is_digest")).alias("digests"), F.count_if(F.col("keyword_match")).alias("keyword_posts"),
        F.min("rerank_score").alias("min_score"), F.sum("rerank_score").alias("score_sum"),
        F.count("rerank_score").alias("score_n"),
    )


def _window_days(datasets: DataFrame) -> DataFrame:
    """The days of every event's window: few rows, which go to every task.

    Rows of (source, day) are brought together by source before they meet them. A source has one row per day
    at most, so no task holds much of one, and sums per event and source need no second shuffle.
    """
    return summary(datasets.select("event_id", "event_slug", window_days(F.col("match_start"), F.col("match_end_exclusive")).alias("activity_date")))


def window_activity(datasets: DataFrame, activity: DataFrame) -> DataFrame:
    """Each source's output inside each event's window (day-exploded range join)."""
    return activity.repartition("source_name").join(_window_days(datasets), "activity_date").groupBy("event_id", "event_slug", "source_name").agg(
        F.sum("post_count").alias("posts_published_in_window"), F.count(F.lit(1)).alias("active_days_in_window"))


def source_window(datasets: DataFrame, activity: DataFrame, groups: DataFrame, by_day: DataFrame) -> DataFrame:
    """Every source publishing in an event's window, covering it or not.

    A source's days and its matched days are brought together by source once, and both are summed per event there.
    """
    matched = ["posts", "first_at", "last_at", "views", "forwards", "digests"]
    slugs = summary(datasets.select(F.col("event_id").alias("_event"), F.col("event_slug").alias("_slug")).distinct())
    covering = by_day.filter(F.col("source_name").isNotNull()).join(slugs, F.col("event_id") == F.col("_event")).select("source_name", "_event", "_slug", *matched)
    both = activity.select("source_name", "activity_date", "post_count").unionByName(covering, allowMissingColumns=True)
    # A matched row has no day, so it meets no window and keeps its own event.
    days = _window_days(datasets).withColumn("_inside", F.lit(True))
    spread = both.repartition("source_name").join(days, "activity_date", "left").filter(F.col("_inside") | F.col("_event").isNotNull())
    event, slug = F.coalesce("_event", "event_id").alias("event_id"), F.when(F.col("_event").isNotNull(), F.col("_slug")).otherwise(F.col("event_slug")).alias("event_slug")
    summed = spread.groupBy(event, slug, "source_name").agg(
        F.sum("post_count").alias("posts_published_in_window"), F.count("_inside").alias("active_days_in_window"),
        F.sum("posts").alias("matched_posts"), F.min("first_at").alias("first_matched_at"), F.max("last_at").alias("last_matched_at"),
        F.sum("views").alias("views_total"), F.sum("forwards").alias("forwards_total"), F.sum("digests").alias("digest_posts"))
    gr = groups.select("source_name", "media_group", "media_group_key")
    return (
        summed.filter("active_days_in_window > 0").join(gr, "source_name", "left")
        .select(
            "event_id", "event_slug", "source_name",
            F.coalesce("media_group", F.lit(UNKNOWN_GROUP)).alias("media_group"),
            F.coalesce("media_group_key", F.lit(UNKNOWN_GROUP_KEY)).alias("media_group_key"),
            "posts_published_in_window", "active_days_in_window",
            F.coalesce("matched_posts", F.lit(0)).alias("matched_posts"),
            F.coalesce("digest_posts", F.lit(0)).alias("digest_posts"),
            "first_matched_at", "last_matched_at", "views_total", "forwards_total",
            F.col("matched_posts").isNotNull().alias("covered_event"))
    )


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole)


def group_coverage(datasets: DataFrame, sources: DataFrame, messages: DataFrame, by_day: DataFrame | None = None) -> DataFrame:
    """One row per group publishing in an event's window, silent groups included."""
    by_group = sources.groupBy("event_id", "event_slug", "media_group", "media_group_key").agg(
        F.count(F.lit(1)).alias("sources_active"), F.count_if(F.col("covered_event")).alias("sources_covering"),
        F.sum("posts_published_in_window").alias("posts_published_in_window"),
        F.sum("matched_posts").alias("matched_posts"), F.sum("digest_posts").alias("digest_posts"),
        F.min("first_matched_at").alias("first_matched_at"), F.max("last_matched_at").alias("last_matched_at"),
        F.sum("views_total").alias("views_total"), F.sum("forwards_total").alias("forwards_total"))
    keys = ["event_id", "media_group"]
    if by_day is None:
        by_day = messages.groupBy(*keys, "published_date").agg(
            F.sum("rerank_score").alias("score_sum"), F.count("rerank_score").alias("score_n"))
    per_post = by_day.groupBy(*keys).agg(
        F.countDistinct("published_date").alias("days_with_coverage"),
        (F.sum("score_sum") / F.nullif(F.sum("score_n"), F.lit(0))).alias("mean_relevance_score"))
    medians = exact_median(messages, keys, "views", "median_views_per_post")
    per_event = Window.partitionBy("event_id")
    rank = F.dense_rank().over(per_event.orderBy(F.col("first_matched_at").asc_nulls_last()))
    ev = datasets.select("event_id", "event_name", "survey_year", "survey_week", "attention_percentage",
                         "match_start", "match_end_exclusive")
    return (
        by_group.withColumn("_event_posts", F.sum("matched_posts").over(per_event))
        .withColumn("first_mention_rank", F.when(F.col("first_matched_at").isNotNull(), rank).cast("long"))
        .join(ev, "event_id").join(per_post, keys, "left").join(medians, keys, "left")
        .select(
            "event_id", "event_slug", "event_name", "survey_year", "survey_week", "attention_percentage",
            "match_start", "match_end_exclusive", "media_group", "media_group_key", "matched_posts", "digest_posts",
            "sources_covering", "sources_active", "posts_published_in_window",
            (F.col("matched_posts") > 0).alias("covered_event"),
            _rate(F.col("matched_posts"), F.col("_event_posts")).alias("share_of_voice"),
            (F.col("sources_covering").cast("double") / F.col("sources_active")).alias("source_coverage_rate"),
            (_rate(F.col("matched_posts") * 1000, F.col("posts_published_in_window"))).alias("matched_posts_per_1000_published"),
            "first_matched_at", "last_matched_at",
            hours_between(F.col("match_start"), F.col("first_matched_at")).alias("coverage_lag_hours"),
            "days_with_coverage", "first_mention_rank", "views_total", "forwards_total", "median_views_per_post",
            _rate(F.col("views_total"), F.col("matched_posts")).alias("views_per_matched_post"),
            "mean_relevance_score")
    )


def group_daily(datasets: DataFrame, sources: DataFrame, by_day: DataFrame) -> DataFrame:
    """Every active group on every day of the window; empty days are zero rows with NULL reach."""
    active = sources.select("event_id", "event_slug", "media_group", "media_group_key").distinct()
    days = datasets.select("event_id", window_days(F.col("match_start"), F.col("match_end_exclusive")).alias("coverage_date"))
    daily = by_day.groupBy("event_id", "media_group", F.col("published_date").alias("coverage_date")).agg(
        F.sum("posts").alias("matched_posts"), F.sum("views").alias("views_total"),
        F.sum("forwards").alias("forwards_total"))
    return active.join(days, "event_id").join(daily, ["event_id", "media_group", "coverage_date"], "left").select(
        "event_id", "event_slug", "media_group", "media_group_key", "coverage_date",
        F.coalesce("matched_posts", F.lit(0)).alias("matched_posts"), "views_total", "forwards_total")


def peak_days(by_day: DataFrame) -> DataFrame:
    """The busiest day of each event; the earliest of equals."""
    daily = by_day.groupBy("event_id", "published_date").agg(F.sum("posts").alias("posts"))
    best = F.max_by(F.struct("published_date", "posts"),
                    F.struct(F.col("posts"), -F.unix_date("published_date"))).alias("_best")
    return daily.groupBy("event_id").agg(best).select(
        "event_id", F.col("_best.published_date").alias("peak_coverage_date"), F.col("_best.posts").alias("peak_coverage_posts"))


def event_overview(datasets: DataFrame, sources: DataFrame, messages: DataFrame, by_day: DataFrame,
                   fulltext_retriever: str = "fulltext", standard_cutoff: float = 0.35) -> DataFrame:
    """One row per event: breadth, timing, reach, provenance and the two trust measures."""
    # Groups and days are counted on the few (event, group, day) cells; only sources are told apart on all rows.
    cells = by_day.groupBy("event_id", "media_group", "published_date").agg(
        *[F.sum(c).alias(c) for c in ("posts", "views", "forwards", "digests", "keyword_posts")],
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.min("min_score").alias("min_score"))
    covered = cells.groupBy("event_id").agg(
        F.sum("posts").alias("matched_posts"),
        F.countDistinct("media_group").alias("groups_covering"), F.min("first_at").alias("first_matched_at"),
        F.max("last_at").alias("last_matched_at"), F.countDistinct("published_date").alias("days_with_coverage"),
        F.sum("views").alias("views_total"), F.sum("forwards").alias("forwards_total"),
        F.min("min_score").alias("min_relevance_score"), F.sum("digests").alias("digest_posts"),
        F.sum("keyword_posts").alias("posts_with_keyword_anchor"))
    covering = by_day.select("event_id", "source_name").distinct().groupBy("event_id").agg(F.count("source_name").alias("sources_covering"))
    universe = sources.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("sources_active"), F.countDistinct("media_group").alias("groups_active"),
        F.sum("posts_published_in_window").alias("posts_published_in_window"))
    joined = datasets
    for part in (covered, covering, universe, peak_days(by_day),
                 exact_median(messages, ["event_id"], "views", "median_views_per_post"),
                 exact_median(messages, ["event_id"], "rerank_score", "median_relevance_score")):
        joined = joined.join(part, "event_id", "left")
    return joined.select(
        "event_id", "event_slug", "event_name", "survey_year", "survey_week", "attention_percentage", "quotes",
        "match_start", "match_end_exclusive", F.datediff("match_end_exclusive", "match_start").alias("window_days"),
        "matched_posts", "digest_posts", "sources_covering", "sources_active", "groups_covering", "groups_active",
        "posts_published_in_window",
        (F.col("sources_covering").cast("double") / F.col("sources_active")).alias("source_coverage_rate"),
        _rate(F.col("matched_posts") * 1000, F.col("posts_published_in_window")).alias("matched_posts_per_1000_published"),
        "first_matched_at", "last_matched_at", "days_with_coverage", "peak_coverage_date", "peak_coverage_posts",
        "views_total", "forwards_total", "median_views_per_post", "retriever", "embed_model", "rerank_model",
        "rerank_threshold", "candidates_reranked", "posts_with_keyword_anchor", "median_relevance_score",
        "min_relevance_score",
        ((F.col("retriever") == fulltext_retriever) | (F.col("rerank_threshold") == standard_cutoff)).alias("standard_relevance_cutoff"),
        "searchable_posts_in_window",
        _rate(F.col("searchable_posts_in_window"), F.col("posts_in_window_all_sources")).alias("searchable_share_of_window"),
        "built_at")


def group_resonance(coverage: DataFrame, overview: DataFrame) -> DataFrame:
    """Each group's slice of an event against its own usual slice, rate and audience."""
    usual = coverage.groupBy("media_group").agg(
        F.sum("matched_posts").alias("_m"), F.sum("posts_published_in_window").alias("_p"), F.sum("views_total").alias("_v"))
    # One row per media group, so a window over all of them is a handful of rows.
    usual = usual.select(
        "media_group",
        (F.col("_m").cast("double") / F.nullif(F.sum("_m").over(Window.partitionBy()), F.lit(0))).alias("baseline_share_of_voice"),
        _rate(F.col("_m") * 1000, F.col("_p")).alias("baseline_per_1000_published"),
        _rate(F.col("_v"), F.col("_m")).alias("baseline_views_per_post"))
    lift = F.col("share_of_voice") / F.nullif(F.col("baseline_share_of_voice"), F.lit(0.0))
    label = (
        F.when(F.col("matched_posts") == 0, "stayed out of it").when(lift >= 1.5, "much more than usual")
        .when(lift >= 1.15, "more than usual").when(lift <= 0.67, "much less than usual")
        .when(lift <= 0.87, "less than usual").otherwise("about as usual"))
    event_views = F.sum("views_total").over(Window.partitionBy("event_id"))
    return (
        coverage.withColumn("_ev", event_views).join(usual, "media_group")
        .join(overview.select("event_id"), "event_id", "left_semi")
        .select(
            "event_id", "event_slug", "event_name", "survey_year", "survey_week", "attention_percentage", "match_start",
            "media_group", "media_group_key", "matched_posts", "posts_published_in_window", "share_of_voice",
            "matched_posts_per_1000_published", "views_total", "views_per_matched_post", "baseline_share_of_voice",
            "baseline_per_1000_published", "baseline_views_per_post", lift.alias("coverage_lift"),
            (F.col("matched_posts_per_1000_published") / F.nullif(F.col("baseline_per_1000_published"), F.lit(0.0))).alias("effort_lift"),
            (F.col("views_per_matched_post") / F.nullif(F.col("baseline_views_per_post"), F.lit(0.0))).alias("audience_lift"),
            (F.col("views_total").cast("double") / F.nullif(F.col("_ev"), F.lit(0))).alias("share_of_event_views"),
            label.alias("coverage_lift_label"))
    )


def coverage_gaps(overview: DataFrame) -> DataFrame:
    """Public attention against media volume, both as positions among the ranked events (one row per event)."""
    ranked = overview.filter(F.col("attention_percentage").isNotNull() & F.col("matched_posts").isNotNull())

    gap = F.col("attention_position") - F.col("volume_position")
    ranked = ranked.crossJoin(F.broadcast(ranked.agg(F.count(F.lit(1)).alias("events_ranked"))))          # one row
    for column, position in (("attention_percentage", "attention_position"), ("matched_posts", "volume_position"), ("matched_posts_per_1000_published", "intensity_position")):
        ranked = percent_ranks(ranked, column, position)
    return (
        ranked.select(
            "event_id", "event_slug", "event_name", "survey_year", "survey_week", "match_start", "attention_percentage",
            "matched_posts", "matched_posts_per_1000_published", "sources_covering", "sources_active", "groups_covering",
            "groups_active", "events_ranked", "attention_position", "volume_position", "intensity_position",
            gap.alias("attention_minus_volume"),
            F.when(gap > 0.25, "noticed more than covered").when(gap < -0.25, "covered more than noticed")
            .otherwise("attention and coverage in line").alias("gap_direction"))
    )


def message_detail(messages: DataFrame) -> DataFrame:
    """The bottom of the drill-down: each matched post with its readable text."""
    text = json_message(F.col("original_message"))
    return messages.select(
        "event_id", "event_slug", "event_name", "media_group", "media_group_key", "source_name", "message_id",
        "published_at", "published_date", "days_from_window_start", "hours_from_window_start", "is_digest", "views",
        "forwards", "rerank_score", "keyword_match", "summary", text.alias("post_text"), F.length(text).alias("post_text_length"))
