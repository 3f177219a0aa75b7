"""The two worked examples every coverage number is judged by."""
import re
from datetime import date, datetime

from newsgauge.operators import coverage as C


def test_group_coverage_two_groups(spark):
    src = "event_id string, event_slug string, source_name string, media_group string, media_group_key string, posts_published_in_window bigint, " \
          "matched_posts bigint, digest_posts bigint, first_matched_at timestamp, last_matched_at timestamp, views_total bigint, forwards_total double, covered_event boolean"
    t = datetime
    sources = spark.createDataFrame([
        ("e", "s", "a1", "Group A", "a", 100, 2, 1, t(2025, 1, 1, 12), t(2025, 1, 2, 12), 300, 30.0, True),
        ("e", "s", "a2", "Group A", "a", 100, 0, 0, None, None, None, None, False),
        ("e", "s", "b1", "Group B", "b", 300, 6, 0, t(2025, 1, 1, 6), t(2025, 1, 3, 12), 1200, 60.0, True)], src)
    posts = [("Group A", 1, 100, .5), ("Group A", 2, 200, .7), ("Group B", 1, 100, .4), ("Group B", 1, 150, .5), ("Group B", 2, 175, .6),
             ("Group B", 2, 200, .7), ("Group B", 3, 250, .8), ("Group B", 3, 325, .9)]
    messages = spark.createDataFrame([("e", g, date(2025, 1, d), v, r) for g, d, v, r in posts],
                                     "event_id string, media_group string, published_date date, views bigint, rerank_score double")
    sets = spark.createDataFrame([("e", "Test", 2025, 1, 20.0, date(2025, 1, 1), date(2025, 1, 15))],
                                 "event_id string, event_name string, survey_year int, survey_week int, attention_percentage double, match_start date, match_end_exclusive date")
    a, b = sorted(C.group_coverage(sets, sources, messages).collect(), key=lambda r: r.media_group)
    got = [(r.matched_posts, r.sources_covering, r.sources_active, r.posts_published_in_window, r.covered_event, r.share_of_voice, r.source_coverage_rate,
            r.matched_posts_per_1000_published, r.coverage_lag_hours, r.days_with_coverage, r.first_mention_rank, r.views_per_matched_post) for r in (a, b)]
    assert got == [(2, 1, 2, 200, True, .25, .5, 10.0, 12, 2, 2, 150.0), (6, 1, 1, 300, True, .75, 1.0, 20.0, 6, 3, 1, 200.0)]
    assert (a.median_views_per_post, b.median_views_per_post) == (150.0, 187.5)


def test_window_crosses_the_year(spark):
    raw = spark.createDataFrame([(2025, 1, "Test", "x", 12.5)], "year int, week int, event string, description string, percentage double")
    r = C.stage_survey(raw, ["none"], ["other"]).first()
    assert (r.week_start, r.week_end, r.match_start, r.match_end_exclusive) == (date(2024, 12, 30), date(2025, 1, 5), date(2024, 12, 27), date(2025, 1, 16))
    assert r.event_kind == "specific event"


def test_sources_of_a_window_are_summed_where_they_are(spark):
    """Silent, undated and unnamed sources, an event with two slugs, posts of no known event; shuffled by source alone."""
    from datetime import timedelta
    first = date(2025, 1, 1)
    day = lambda n: first + timedelta(days=n)
    at = lambda n: datetime(2025, 1, 1) + timedelta(days=n)
    datasets = [("e1", "a", 0, 4), ("e1", "b", 2, 6), ("e2", None, 1, 3), (None, "n", 0, 2)]
    activity = [(f"s{s}" if s else None, n, s + n + 1) for s in range(4) for n in range(7) if (s + n) % 3]
    by_day = [("e1", "s1", 0, 2), ("e1", "s1", 3, 1), ("e2", "s2", 2, 4), ("e1", None, 1, 5), ("e9", "s1", 1, 7), (None, "s1", 1, 3), ("e2", "s9", 1, 1)]
    ds = spark.createDataFrame([(e, s, day(a), day(b)) for e, s, a, b in datasets], "event_id string, event_slug string, match_start date, match_end_exclusive date")
    act = spark.createDataFrame([(s, day(n), c) for s, n, c in activity], "source_name string, activity_date date, post_count bigint")
    seen = spark.createDataFrame([(e, s, day(n), c, at(n), at(n), 10 * c, None, 1) for e, s, n, c in by_day],
                                 "event_id string, source_name string, published_date date, posts bigint, first_at timestamp, last_at timestamp, views bigint, forwards bigint, digests bigint")
    groups = spark.createDataFrame([("s1", "One", "one")], "source_name string, media_group string, media_group_key string")
    want, active = {}, {}
    for e, slug, a, b in datasets:
        for s in {r[0] for r in activity}:
            mine = [c for t, n, c in activity if t == s and a <= n < b]
            hits = [(n, c) for f, t, n, c in by_day if f == e and t == s and e and s]
            if mine:
                active[e, slug, s] = (sum(mine), len(mine))
                want[e, slug, s] = (sum(mine), len(mine), sum(c for _, c in hits), len(hits), min((at(n) for n, _ in hits), default=None),
                                    10 * sum(c for _, c in hits) if hits else None, None, bool(hits), "One" if s == "s1" else C.UNKNOWN_GROUP)
    plain = C.window_activity(ds, act)
    assert {(r.event_id, r.event_slug, r.source_name): (r.posts_published_in_window, r.active_days_in_window) for r in plain.collect()} == active
    rows = C.source_window(ds, act, groups, seen)
    got = {(r.event_id, r.event_slug, r.source_name): (r.posts_published_in_window, r.active_days_in_window, r.matched_posts, r.digest_posts, r.first_matched_at,
                                                       r.views_total, r.forwards_total, r.covered_event, r.media_group) for r in rows.collect()}
    assert got == want and len(got) == rows.count()
    for df in (C.window_activity(ds, act), C.source_window(ds, act, groups, seen)):
        shuffles = re.findall(r"Exchange hashpartitioning\((.*?),", df._jdf.queryExecution().executedPlan().toString())
        assert shuffles and all(key.startswith("source_name#") for key in shuffles), shuffles
