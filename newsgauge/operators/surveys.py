"""Survey lists: report flattening and merging, wording profiles, theme labels, navigation and pilot order."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.functions.dates import survey_week_from_phrase, week_key
from newsgauge.functions.text import parse_quotes, percent_value, report_year_week, wording_key
from newsgauge.operators.scaling import rank_in_blocks


def flatten_reports(reports: DataFrame, skip_containing: str, overrides: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(file_name, events array) to one row per event, non-response rows dropped, place by share within the report.

    Files whose name holds no week and that are not listed give no rows.
    """
    when = report_year_week(F.col("file_name"), overrides)
    rows = (
        reports.withColumn("_w", when).filter(F.col("_w.year").isNotNull() & F.col("_w.week").isNotNull())
        .select("file_name", F.col("_w.year").alias("year"), F.col("_w.week").alias("week"), F.posexplode("events").alias("_i", "_e"))
        .select("file_name", "year", "week", F.format_string("%d-%02d", "year", "week").alias("date"), F.col("_e.name").alias("event"),
                F.col("_e.quotes").alias("description"), percent_value(F.col("_e.percent")).alias("percentage"), "_i")
        .filter(~F.coalesce(F.col("event").contains(skip_containing), F.lit(False))))
    place = Window.partitionBy("file_name").orderBy(F.col("percentage").desc_nulls_last(), "_i")
    return rows.withColumn("place", F.row_number().over(place).cast("long")).drop("_i")


def merge_reports(old: DataFrame, new: DataFrame) -> DataFrame:
    """Reports of `new` are added only where `old` has none."""
    return old.unionByName(new.join(old.select("file_name"), "file_name", "left_anti"))


def compare_reports(old: DataFrame, new: DataFrame) -> DataFrame:
    """For reports in both, how many event names they share and how many only one of them has."""
    def names(c: str) -> Column:
        return F.array_distinct(F.transform(F.col(c), lambda e: F.trim(e["name"])))
    a, b = names("_old"), names("_new")
    return old.select("file_name", F.col("events").alias("_old")).join(new.select("file_name", F.col("events").alias("_new")), "file_name").select(
        "file_name", F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_except(a, b)).alias("only_old"),
        F.size(F.array_except(b, a)).alias("only_new"))


def check_report_weeks(texts: DataFrame) -> DataFrame:
    """The week printed in a report against the week in its file name."""
    found = survey_week_from_phrase(F.col("text"), F.col("year"))
    return texts.withColumn("_f", found).select(
        "file_name", F.col("_f.year").alias("printed_year"), F.col("_f.week").alias("printed_week"),
        (~F.struct(F.col("_f.year"), F.col("_f.week")).eqNullSafe(F.struct("year", "week"))).alias("mismatch"))


def bare_quotes(raw: Column) -> Column:
    """Quotes of a list literal without their guillemets; anything that is no list has none."""
    listed = F.trim(F.coalesce(raw, F.lit(""))).startswith("[")
    bare = F.transform(parse_quotes(raw), lambda q: F.btrim(q, F.lit("«»")))
    return F.when(listed, bare).otherwise(F.array().cast("array<string>"))


def wording_profile(rows: DataFrame) -> DataFrame:
    """One row per wording: usual spelling, weeks named, peak share, its first three distinct quotes, spellings.

    Input: event_name, survey_year, survey_week, week_start, attention_percentage, quote_examples.
    """
    r = rows.select("event_name", "week_start", "attention_percentage", "quote_examples",
                    week_key(F.col("survey_year"), F.col("survey_week")).alias("wk"), wording_key(F.col("event_name")).alias("key"))
    base = r.groupBy("key").agg(
        F.countDistinct("wk").alias("n_weeks"), F.min_by("wk", "week_start").alias("first_week"), F.max_by("wk", "week_start").alias("last_week"),
        F.array_join(F.array_sort(F.collect_set("wk")), " ").alias("weeks"), F.max("attention_percentage").alias("peak_pct"),
        F.array_join(F.array_sort(F.collect_set("event_name")), " || ").alias("spellings"), F.min("week_start").alias("first_start"))
    spelled = r.groupBy("key", "event_name").agg(F.count(F.lit(1)).alias("n"))
    usual = spelled.groupBy("key").agg(F.min_by("event_name", F.struct(-F.col("n"), F.col("event_name"))).alias("name"))
    quotes = r.select("key", "week_start", F.posexplode(bare_quotes(F.col("quote_examples"))).alias("pos", "quote"))
    first = quotes.groupBy("key", "quote").agg(F.min(F.struct("week_start", "pos")).alias("at"))
    three = (
        first.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("at", "quote"))).filter("rn <= 3")
        .groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "quote"))), lambda s: s["quote"]), " | ").alias("quotes")))
    return base.join(usual, "key").join(three, "key", "left").withColumn("quotes", F.coalesce("quotes", F.lit("")))


def unlabelled_slices(profile: DataFrame, labelled: DataFrame, size: int = 50) -> DataFrame:
    """Wordings without a label, in order of first appearance, cut into slices."""
    left = profile.join(labelled.select("key"), "key", "left_anti")
    ranked = rank_in_blocks(left, [], F.col("first_start"), [F.col("first_start"), F.col("key")], "place")
    return ranked.withColumn("slice", F.floor((F.col("place") - 1) / size).cast("long"))


def latest_labels(answers: DataFrame) -> DataFrame:
    """Per wording key the answer of the latest run (key, theme_id, labelled_on, run)."""
    return answers.groupBy("key").agg(F.max_by(F.struct("theme_id", "labelled_on"), "run").alias("v")).select("key", "v.*")


def theme_seed(profile: DataFrame, seed: DataFrame, answers: DataFrame, themes: DataFrame) -> DataFrame:
    """One row per exact spelling: seed labels first, later answers win, a new spelling takes its wording's theme.

    status says whether the label stands, names a theme that does not exist, or is missing.
    """
    old = seed.select(wording_key(F.col("event_name")).alias("key"), "theme_id", "labelled_on", F.lit(0).alias("run"))
    labels = latest_labels(old.unionByName(answers.select("key", "theme_id", "labelled_on", "run")))
    known = themes.select("theme_id", F.lit(True).alias("_known"))
    spelled = profile.select("key", F.explode(F.split("spellings", r" \|\| ")).alias("event_name"))
    return spelled.join(labels, "key", "left").join(known, "theme_id", "left").select(
        "event_name", "theme_id", "labelled_on",
        F.when(F.col("theme_id").isNull(), "missing").when(F.col("_known").isNull(), "unknown theme").otherwise("ok").alias("status"))


def cross_year_link(events: DataFrame) -> DataFrame:
    """How far themes link events across years: by wording alone, and by wording or named theme.

    An event is linked through its theme when the theme holds another wording in another year; that is
    counted from the theme's (wording, year) pairs, without pairing events.
    """
    e = events.filter((F.col("event_kind") == "specific event") & F.col("theme_id").isNotNull())
    pairs = e.groupBy("theme_id", "is_other_theme", "event_name", F.year("week_start").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    theme, wording, year = Window.partitionBy("theme_id"), Window.partitionBy("theme_id", "event_name"), Window.partitionBy("theme_id", "y")
    one = F.count(F.lit(1))
    flagged = (
        pairs.withColumn("_p", one.over(theme)).withColumn("_w", one.over(wording)).withColumn("_y", one.over(year))
        .withColumn("by_wording", F.col("_w") > 1)
        .withColumn("by_theme", ~F.col("is_other_theme") & (F.col("_p") - F.col("_w") - F.col("_y") + 1 > 0)))
    total = flagged.agg(
        F.sum("n").alias("events"), F.sum(F.when(F.col("by_wording"), F.col("n")).otherwise(0)).alias("w"),
        F.sum(F.when(F.col("by_wording") | F.col("by_theme"), F.col("n")).otherwise(0)).alias("t"))
    shares = total.select(F.expr(
        "stack(3, 'events', cast(events as double), 'linked by wording', w / cast(events as double), 'linked by wording or theme', t / cast(events as double)) as (measure, value)"))
    spans = pairs.groupBy("theme_id").agg(F.countDistinct("y").alias("years")).groupBy("years").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return shares.unionByName(spans.select(F.format_string("themes seen in %d years", "years").alias("measure"), "value"))


def pilot_order(events: DataFrame, pilot: int = 50) -> DataFrame:
    """Every event with its turn: `pilot` events spread evenly in date order first, then the rest in date order."""
    ranked = rank_in_blocks(events, [], F.col("week_start"), [F.col("week_start"), F.col("event_id")], "rn")
    n = events.agg(F.count(F.lit(1)).alias("n"))
    k = F.col("n").cast("double") / pilot
    i = (F.col("rn") - 1).cast("double")
    # The pilot takes index floor(j * k); j is the least whole number with j * k >= i.
    j = F.ceil(i / k)
    is_pilot = (j < pilot) & (F.floor(j * k) == i)
    before = F.least(F.floor(i / k) + 1, F.lit(pilot))
    placed = ranked.crossJoin(F.broadcast(n)).withColumn("is_pilot", is_pilot)   # n is one row
    return placed.withColumn("turn", F.when(F.col("is_pilot"), j + 1).otherwise(F.lit(pilot) + F.col("rn") - before).cast("long")).drop("rn", "n")
