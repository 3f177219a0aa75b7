"""Posts out of public channel preview pages: one page is one string, one post is one section of it."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.functions.text import balanced, element_text, short_count


@dataclass(frozen=True)
class Markup:
    """How a preview page marks its posts; patterns are for Java regular expressions."""

    post: str = 'data-post="'
    key: str = r'^([^"/]+)/(\d+)"'
    date: str = r'<time datetime="([^"]+)"'
    text: str = r'(?s)<div class="[^"]*\bmessage_text\b[^"]*">(.*)'
    views: str = r'<span class="message_views">([^<]+)</span>'
    media: str = r"message_(?:photo|video|document|voice|audio|poll|sticker)"
    unreadable: str = r"message_media_not_supported|text_not_supported_wrap"
    # Service lines a channel writes itself.
    service: str = r"(?i)^The owner of this channel has been inactive for the last \d+ months?\b|^Channel created$|^Channel name was changed to "


def _group(section: Column, pattern: str, index: int = 1) -> Column:
    return F.nullif(F.regexp_extract(section, pattern, index), F.lit(""))


def sections(pages: DataFrame, page: str, html: str, markup: Markup = Markup()) -> DataFrame:
    """One row per marked post: handle, number, the raw section and its instant (NULL when unreadable)."""
    parts = F.split(F.col(html), markup.post, -1)
    cut = pages.select(page, F.posexplode(parts).alias("_i", "section")).filter("_i > 0").drop("_i")
    at = F.try_to_timestamp(_group(F.col("section"), markup.date))
    return cut.withColumn("handle", _group(F.col("section"), markup.key)).withColumn(
        "message_id", _group(F.col("section"), markup.key, 2).try_cast("bigint")).withColumn("at", at).filter(F.col("message_id").isNotNull())


def parse_posts(pages: DataFrame, page: str, html: str, markup: Markup = Markup()) -> DataFrame:
    """Dated posts with their text, kind of record, media flag and view count."""
    s = F.col("section")
    text = element_text(balanced(F.coalesce(F.regexp_extract(s, markup.text, 1), F.lit(""))))
    kind = (
        F.when(F.col("text").rlike(markup.service), "service").when(F.col("text") != "", "text").when(s.rlike(markup.unreadable), "unreadable")
        .when(s.rlike(markup.media), "media_only").otherwise("empty"))
    views = _group(s, markup.views)
    return (
        sections(pages, page, html, markup).filter(F.col("at").isNotNull()).withColumn("text", text)
        .select(page, "message_id", "handle", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("published_utc"), "text", kind.alias("record_type"),
                s.rlike(markup.media).alias("has_media"), views.alias("views_text"), short_count(views).alias("views")))


def undated(pages: DataFrame, page: str, html: str, markup: Markup = Markup()) -> DataFrame:
    """How many marked posts of each page have no readable date."""
    return sections(pages, page, html, markup).groupBy(page).agg(F.count(F.lit(1)).alias("posts"), F.count_if(F.col("at").isNull()).alias("undated"))
