"""Readers, sinks, checks and the collector stream on files."""
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from newsgauge.operators import quality as Q
from newsgauge.plans.parameterised import run_sql
from newsgauge.session import run_dir
from newsgauge.sources import previews as PV
from newsgauge.sources import readers as RD
from newsgauge.sources import sinks as SK
from newsgauge.sources.store import PostStore
from newsgauge.streaming.collector import daily_coverage, follow_posts

POST = "source_name string, message_id bigint, published_at timestamp"


def test_preview_page(spark):
    html = ('<div data-post="chan/1"><time datetime="2025-01-02T03:00:00+03:00"><div class="x message_text">a &amp; b<br>c <b>d</b></div><span class="message_views">1.5K</span></div>'
            '<div data-post="chan/2"><div class="message_text">no date</div></div><div data-post="chan/3"><time datetime="2025-01-02T00:00:00Z"><i class="message_photo"></i></div>'
            '<div data-post="chan/4"><time datetime="bad"></div><div data-post="chan/5"><time datetime="2025-01-02T00:00:00Z"><div class="message_text">Channel created</div></div>')
    pages = spark.createDataFrame([(1, html)], "page bigint, html string")
    got = [(r.message_id, r.published_utc, r.text, r.record_type, r.has_media, r.views) for r in PV.parse_posts(pages, "page", "html").orderBy("message_id").collect()]
    assert got == [(1, "2025-01-02T00:00:00", "a & b c d", "text", False, 1500), (3, "2025-01-02T00:00:00", "", "media_only", True, None),
                   (5, "2025-01-02T00:00:00", "Channel created", "service", False, None)]
    assert PV.undated(pages, "page", "html").first().undated == 2


def test_empty_search_that_kept_posts_stops_the_load(spark):
    row = '{"event": {"slug": "s", "name": "n", "year": 2025, "week": 1}, "counts": {"kept": %d}}'
    good, bad = run_dir(spark, "m"), run_dir(spark, "m")
    spark.createDataFrame([(row % 0,)], "value string").write.text(good)
    spark.createDataFrame([(row % 3,)], "value string").write.text(bad)
    assert RD.empty_searches(RD.read_manifests(spark, good)).first().kept == 0
    with pytest.raises(Exception, match="kept 3 posts"):
        RD.empty_searches(RD.read_manifests(spark, bad)).collect()
    assert RD.manifest_rows(RD.read_manifests(spark, good)).first().retriever == "summary"


def test_bundles_refuse_gaps(spark):
    events = spark.createDataFrame([("e1",)], "event_id string")
    part = spark.createDataFrame([("e1", 1), ("e2", 2)], "event_id string, n int")
    with pytest.raises(Exception, match="unknown event e2"):
        SK.detail_bundles(events, {"rows": part}).collect()


def test_publish_keeps_the_old_set_until_all_is_written(spark):
    folder, names = run_dir(spark, "p"), ["a", "b"]
    with pytest.raises(RuntimeError, match="not given: b"):
        SK.publish({"a": spark.range(3)}, names, folder)
    assert SK.publish({"a": spark.range(3), "b": spark.range(4), "c": spark.range(1)}, names, folder) == 1
    with pytest.raises(Exception, match="broken"):
        SK.publish({"a": spark.range(9), "b": spark.range(1).select(F.raise_error(F.lit("broken")).alias("id"))}, names, folder)
    assert SK.read_published(spark, folder, "a").count() == 3
    assert SK.publish({"a": spark.range(5), "b": spark.range(0)}, names, folder) == 2
    assert {(r.mart, r.rows) for r in SK.published_counts(spark, folder).collect()} == {("a", 5), ("b", 0)}
    assert SK.read_published(spark, folder, "a").count() == 5 and SK.read_published(spark, folder, "b").count() == 0
    with pytest.raises(LookupError):
        SK.read_published(spark, folder, "c")


def test_a_run_is_counted_while_it_is_written(spark):
    rows = spark.createDataFrame([(1, 0.9, True), (2, 0.2, True), (3, 0.8, False), (4, 0.1, False)], "id int, s double, word boolean")
    passes = spark.sparkContext.accumulator(0)
    counted = rows.rdd.map(lambda r: (passes.add(1), r)[1]).toDF(rows.schema)
    assert SK.write_run(counted, "s", 0.5, "word", {"retriever": "x"}, folder := run_dir(spark, "run")) == {"candidates": 4, "kept": 2, "kept_keyword": 1, "kept_semantic_only": 1}
    assert passes.value == 4                                                 # one pass over the candidates
    back = spark.read.json(f"{folder}/manifest").first()
    assert back.params.retriever == "x" and back.counts.keyword_pool_retention == 0.5 and spark.read.parquet(f"{folder}/candidates").count() == 4


def test_checks_find_what_is_wrong(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (2, "z", "y")], "id int, kind string, v string")
    assert Q.unique(df, ["id"]).count() == 1 and Q.unique(df, ["id"], "kind = 'a'").count() == 0
    assert Q.not_null(df, "v").count() == 1 and Q.not_null(df, "v", "id = 2").count() == 0
    assert [(r.value, r.rows_found) for r in Q.accepted_values(df, "kind", ["a", "b"]).collect()] == [("z", 1)]
    assert [r.value for r in Q.relationships(df, "kind", df.filter("id = 1"), "kind").collect()] == ["z"]
    cov = spark.createDataFrame([("e", "g", 5, 4, 1, 1, 0.5)], "event_id string, media_group string, matched_posts int, posts_published_in_window int, sources_covering int, sources_active int, share_of_voice double")
    assert Q.coverage_within_activity(cov).count() == 1 and Q.voice_adds_up(cov).count() == 1
    msg = spark.createDataFrame([("e", "s", "x", 1, date(2025, 1, 9), date(2025, 1, 1), date(2025, 1, 9))],
                                "event_id string, event_slug string, source_name string, message_id int, published_date date, match_start date, match_end_exclusive date")
    assert Q.inside_window(msg).count() == 1


def test_parameterised_sql_drops_empty_pieces(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, k string")
    q = "select n from {t} where n >= :low [[and k = :k]]"
    assert run_sql(spark, q, {"t": df}, {"low": 1, "k": None}).count() == 2
    assert [r.n for r in run_sql(spark, q, {"t": df}, {"low": 1, "k": "b' or 'x' = 'x"}).collect()] == []
    assert [r.n for r in run_sql(spark, q, {"t": df}, {"low": 1, "k": "b"}).collect()] == [2]


T = lambda d, h=0: datetime(2025, 1, d, h)


def store_of(spark, rows=()):
    store = PostStore(spark, run_dir(spark, "store"), POST, "source_name", "published_at", "message_id").create()
    if rows:
        store.append(spark.createDataFrame(rows, POST), "archive")
    return store


def held(store):
    return sorted((r.source_name, r.message_id) for r in store.posts().collect())


def test_collector_appends_newer_posts_once(spark):
    arriving, store = run_dir(spark, "in"), store_of(spark, [("a", 1, T(1)), ("a", 2, T(5))])
    spark.createDataFrame([("a", 2, T(5)), ("a", 3, T(4)), ("a", 4, T(6)), ("a", 4, T(6)), ("b", 1, T(1)), ("a", 2, T(9)), ("a", 0, T(8))], POST).write.parquet(arriving)
    for _ in range(2):          # a second run over the same files adds nothing
        follow_posts(store, arriving).awaitTermination()
    assert held(store) == [("a", 0), ("a", 1), ("a", 2), ("a", 4), ("b", 1)]


def test_a_batch_killed_half_way_is_replayed(spark, monkeypatch):
    arriving, store, checkpoint = run_dir(spark, "in"), store_of(spark, [("a", 1, T(1))]), run_dir(spark, "check")
    spark.createDataFrame([("a", 2, T(2)), ("b", 7, T(3))], POST).write.parquet(arriving)

    def killed(*_):
        raise OSError("the driver is gone")
    monkeypatch.setattr(PostStore, "_commit", killed)
    with pytest.raises(Exception, match="driver is gone"):
        follow_posts(store, arriving, checkpoint).awaitTermination()
    monkeypatch.undo()
    left = spark.read.parquet(f"{store.folder}/posts")
    assert left.count() == 3 and held(store) == [("a", 1)]                   # posts of the dead batch lie there, no reader sees them
    follow_posts(store, arriving, checkpoint).awaitTermination()
    assert held(store) == [("a", 1), ("a", 2), ("b", 7)] and spark.read.parquet(f"{store.folder}/posts").count() == 3
    batch = sorted(store.committed()[1] - {"archive"})[0]
    assert not store.append(spark.createDataFrame([("a", 3, T(9))], POST), batch)      # committed once, whatever comes again under its name


def test_only_wanted_folders_are_read(spark):
    store = store_of(spark, [("a", d, T(d)) for d in range(1, 20)])
    for k in range(3):
        store.append(spark.createDataFrame([("a", 30 + k, T(20 + k))], POST), f"b{k}")
    assert {(r.source, r.newest, r.largest) for r in store.newest().collect()} == {("a", T(22), 32)}
    plan = store.posts((F.col("month") >= F.lit("2025-01-01").cast("date")) & (F.col("batch") != "archive"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    fresh = store.fresh(spark.createDataFrame([("a", 40, T(23)), ("b", 1, T(1))], POST), 4)
    assert "/posts" not in str(fresh.inputFiles()) and sorted(r.message_id for r in fresh.collect()) == [1, 40]


def test_daily_coverage_of_a_stream_with_late_and_repeated_posts(spark):
    schema = "source_name string, message_id bigint, published_at timestamp, media_group string, views bigint"
    folder, out, checkpoint = run_dir(spark, "in"), run_dir(spark, "days"), run_dir(spark, "check")
    batches = [[("a", 1, T(1), "g", 10), ("a", 2, T(1, 5), "g", 1), ("a", 1, T(1), "g", 10)], [("a", 3, T(2), "h", 5), ("a", 1, T(1), "g", 10), ("b", 9, T(1, 23), "g", 2)],
               [("a", 4, T(9), "g", 1)], [("b", 1, T(1), "g", 100), ("a", 5, T(8), "g", 3)], [("a", 6, T(20), "g", 1)], [("a", 7, T(28), "g", 1)]]
    for rows in batches:                                                     # one file, one batch
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = daily_coverage(spark.readStream.schema(schema).parquet(folder), "published_at", ["source_name", "message_id"], "media_group")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(str(r.day), r.media_group): (r.posts, r.views) for r in spark.read.parquet(out).collect()}
    assert got == {("2025-01-01", "g"): (3, 13), ("2025-01-02", "h"): (1, 5), ("2025-01-08", "g"): (1, 3), ("2025-01-09", "g"): (1, 1), ("2025-01-20", "g"): (1, 1)}


def test_resume_skips_done_and_broken_lines(spark):
    lines = spark.createDataFrame([('{"message_id": 1}',), ('{"message_id": 2',), ("",), ('{"other": 3}',)], "value string")
    rows = spark.createDataFrame([(i,) for i in range(1, 5)], "message_id bigint")
    assert sorted(r.message_id for r in RD.pending(rows, RD.read_done_ids(lines)).collect()) == [2, 3, 4]
    stacked = run_dir(spark, "csv")
    spark.createDataFrame([("a", "7", "x")], "source_name string, message_id string, views string").write.csv(stacked, header=True)
    r = RD.read_match_stack(spark, [stacked]).first()
    assert (r.message_id, r.views) == (7, None) and F is not None


def test_nested_blocks_and_references(spark):
    page = ('<div data-post="chan/1"><time datetime="2025-01-02T03:00:00+03:00"><div class="message_text">one <div>two<br>&#1078;&#x2014;</div> three &hellip;&nbsp;&amp;lt; &nope; &#128; &#xD800; a & b'
            '<img src="x"> <b>four</b></div><div>not this</div>')
    got = PV.parse_posts(spark.createDataFrame([(1, page)], "page bigint, html string"), "page", "html").first()
    assert got.text == "one two \u0436\u2014 three \u2026 &lt; &nope; \u20ac \ufffd a & b four"
