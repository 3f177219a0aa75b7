"""Data checks over the marts with their checking SQL; an empty answer is a pass."""
from __future__ import annotations

from pyspark.sql import functions as F

from newsgauge.functions import wording as W
from newsgauge.operators import quality as Q
from newsgauge.operators import vocabulary as V
from newsgauge.plans.catalog import query


@query("dq_unique", """select 'whole' as scope, source_name, message_id, count(*) as rows_found from x_posts group by all having count(*) > 1
  union all select 'flag', source_name, message_id, count(*) from x_posts where flag <> 'N' group by all having count(*) > 1""")
def _(d):
    whole, scoped = (Q.unique(d.posts, ["source_name", "message_id"], *where).withColumn("scope", F.lit(name)) for name, where in (("whole", []), ("flag", ["flag <> 'N'"])))
    return whole.unionByName(scoped)


@query("dq_not_null", """select 'whole' as scope, event_id, source_name, message_id from x_messages where forwards is null
  union all select 'digest', event_id, source_name, message_id from x_messages where forwards is null and is_digest""")
def _(d):
    whole, scoped = (Q.not_null(d.messages, "forwards", *where).select(F.lit(name).alias("scope"), "event_id", "source_name", "message_id") for name, where in (("whole", []), ("digest", ["is_digest"])))
    return whole.unionByName(scoped)


@query("dq_accepted_values", "select media_group as value, count(*) as rows_found from x_messages where media_group not in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE') group by 1")
def _(d):
    return Q.accepted_values(d.messages, "media_group", ["AFRICA", "AMERICA", "ASIA", "EUROPE"])


@query("dq_relationships", "select source_name as value, count(*) as rows_found from x_posts where source_name not in (select source_name from x_groups) group by 1")
def _(d):
    return Q.relationships(d.posts, "source_name", d.groups, "source_name")


@query("dq_coverage_le_activity", """select event_id, media_group, matched_posts, posts_published_in_window, sources_covering, sources_active from x_coverage
  where matched_posts > posts_published_in_window or sources_covering > sources_active""")
def _(d):
    return Q.coverage_within_activity(d.coverage)


@query("dq_unique_group_event", "select event_id, media_group, count(*) as rows_found from x_coverage group by all having count(*) > 1")
def _(d):
    return Q.unique(d.coverage, ["event_id", "media_group"])


@query("dq_inside_window", """select event_id, event_slug, source_name, message_id, published_date, match_start, match_end_exclusive from x_messages
  where published_date < match_start or published_date >= match_end_exclusive""")
def _(d):
    return Q.inside_window(d.messages)


@query("dq_manifest_recon", """select coalesce(d.event_id, o.event_id) as event_id, d.matched_posts_expected, o.matched_posts from x_datasets d full join x_overview o on o.event_id = d.event_id
  where d.matched_posts_expected is distinct from o.matched_posts""")
def _(d):
    return Q.manifests_reconciled(d.datasets, d.overview)


@query("dq_baselines_sum", """select which, total from (select 'baseline shares' as which, sum(b) as total from (select media_group, any_value(baseline_share_of_voice) as b from x_resonance group by 1)
  union all select 'event ' || event_id, sum(share_of_voice) from x_resonance group by event_id) where abs(total - 1) > 0.000001""", "total")
def _(d):
    return Q.baselines_consistent(d.resonance)


@query("dq_share_in_range", "select event_id, event_slug, searchable_share_of_window from x_overview where searchable_share_of_window not between 0 and 1")
def _(d):
    return Q.share_in_range(d.overview)


@query("dq_voice_sum", "select event_id, sum(share_of_voice) as total_share from x_coverage group by 1 having abs(sum(share_of_voice) - 1) > 0.000001", "total_share")
def _(d):
    return Q.voice_adds_up(d.coverage)


@query("dq_hash_unique", """select h as term_hash, min(t) as first, max(t) as last from (select distinct (hash(term_type, term_key) >> 1)::bigint as h, term_type || ' ' || term_key as t from x_forms) group by 1 having min(t) <> max(t)""")
def _(d):
    return Q.one_term_per_fingerprint(V.each_term(d.terms))


@query("dq_list_count", """select event_id, media_group, term_type, term_key, posts_with_term, n as posts_in_list from x_kept left join (select event_id, media_group, term_type, term_key, count(*) as n from x_tpo group by all)
  using (event_id, media_group, term_type, term_key) where posts_with_term is distinct from n""")
def _(d):
    return Q.lists_match_counts(d.kept_terms, V.term_lists(d.term_posts))


@query("dq_not_one_channel", """select event_id, media_group, term_type, term_key, sources_with_term, top_source_share_of_term from x_kept
  where sources_with_term < least(2, group_sources) or (sources_with_term >= 3 and top_source_share_of_term > 0.7)""")
def _(d):
    return Q.not_one_channels_habit(d.kept_terms)


@query("dq_each_post_once", """select a as rolled_up_posts, b as distinct_posts from (select sum(distinct_matched_posts)::bigint as a from x_themecoverage where scope_type = 'all'),
  (select count(distinct source_name || ':' || message_id) as b from x_messages) where a <> b""")
def _(d):
    return Q.each_post_once(d.theme_coverage, d.messages)


@query("dq_single_event_equal", """with s as (select 'theme' as scope_type, theme_id as scope_id, event_id from x_weekevents where theme_id is not null and event_id in (select event_id from x_datasets)
    union all select 'umbrella', umbrella_id, event_id from x_weekevents where umbrella_id is not null and event_id in (select event_id from x_datasets)),
  one as (select scope_type, scope_id, min(event_id) as event_id from s group by 1, 2 having count(*) = 1),
  r as (select o.event_id, media_group, distinct_matched_posts as a, posts_published_in_union_window as b from x_themecoverage join one o using (scope_type, scope_id)),
  e as (select event_id, media_group, matched_posts as c, posts_published_in_window as p from x_coverage where event_id in (select event_id from one))
  select coalesce(r.event_id, e.event_id) as event_id, coalesce(r.media_group, e.media_group) as media_group, a as distinct_matched_posts, b as posts_published_in_union_window, c as matched_posts, p as posts_published_in_window
  from r full join e on e.event_id = r.event_id and e.media_group = r.media_group where a is distinct from c or b is distinct from p""")
def _(d):
    return Q.single_event_equal(d.week_events, d.datasets, d.theme_coverage, d.coverage)


@query("dq_override_matches", """select o.survey_year, o.survey_week, o.event_name from (select survey_year, survey_week + case when survey_week = 52 then 30 else 0 end as survey_week, event_name from x_survey
  where survey_week % 13 = 0 and digit = 1) o left join x_survey s using (survey_year, survey_week, event_name) where s.event_id is null""")
def _(d):
    moved = d.week_overrides.withColumn("survey_week", F.col("survey_week") + F.when(F.col("survey_week") == 52, 30).otherwise(0))
    return Q.overrides_match(moved, d.survey).select("survey_year", "survey_week", "event_name")


@query("dq_theme_week_unique", """select 'theme_week_attention' as model, theme_id as scope_id, week_start::varchar as part, count(*) as rows_found from x_attention group by 2, 3 having count(*) > 1
  union all select 'theme_group_coverage', scope_type || ':' || scope_id, media_group, count(*) from x_themecoverage group by 2, 3 having count(*) > 1""")
def _(d):
    return Q.theme_weeks_unique(d.theme_attention, d.theme_coverage)


@query("dq_nonstandard_warn", f"""select event_slug, retriever, rerank_threshold, matched_posts, searchable_posts_in_window, posts_published_in_window, round(searchable_share_of_window, 3) as searchable_share_of_window,
  case when not standard_relevance_cutoff and searchable_share_of_window < 0.9 then {W.quoted(W.LOOSE_AND_PART)}
    when not standard_relevance_cutoff then {W.quoted(W.LOOSE_ONLY)} else {W.quoted(W.PART_ONLY)} end as reason, 'warn' as severity
  from x_overview where not standard_relevance_cutoff or searchable_share_of_window < 0.9""")
def _(d):
    return Q.nonstandard_settings(d.overview)


@query("dq_theme_every_event", "select event_id, event_name, 'warn' as severity from x_themed where event_kind = 'specific event' and (theme_id is null or survey_week = 53)")
def _(d):
    gap = d.themed.withColumn("theme_id", F.when(F.col("survey_week") != 53, F.col("theme_id")))
    return Q.theme_for_every_event(gap)
