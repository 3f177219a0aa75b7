"""Reading, writing, profiling and preview-page queries with their checking SQL.

Files are written to the shared folder and read back, so what is checked is the round trip.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from newsgauge.functions.text import element_text, short_count
from newsgauge.operators import profiles as P
from newsgauge.operators.scaling import rank_by_score
from newsgauge.plans.catalog import query, sql_view
from newsgauge.session import run_dir
from newsgauge.sources import previews as PV
from newsgauge.sources import readers as RD
from newsgauge.sources import sinks as SK
from newsgauge.sources.store import PostStore


@query("src_csv_infer", "select year, week, event, nullif(description, '') as description, percentage from x_rawsurvey")
def _(d):
    path = run_dir(d.spark, "survey-csv")
    d.raw_survey.write.csv(path, header=True, escape='"')
    return RD.read_csv_inferred(d.spark, path)


_STACK_COLUMNS = ["event_id", "source_name", "message_id", "is_digest", "views", "forwards", "rerank_score", "keyword_match", "survey_year"]


@query("src_csv_typed_stack", """select event_id, source_name, message_id, case when message_id % 7 = 0 then null else is_digest::bigint end as is_digest, views,
  case when survey_year >= 1996 then null else forwards end as forwards, rerank_score, keyword_match, survey_year
  from x_rawmatches join (select event_id, survey_year from x_survey) using (event_id) where source_name not in (select source_name from x_archived)""", "rerank_score")
def _(d):
    digest = F.when(F.col("message_id") % 7 == 0, "unknown").otherwise(F.col("is_digest").cast("int").cast("string"))
    rows = d.raw_matches.join(d.survey.select("event_id", "survey_year"), "event_id").withColumn("is_digest", digest).drop("event_slug", "published_date")
    folder = run_dir(d.spark, "matches-csv")
    for name, part in (("old", rows.filter("survey_year < 1996")), ("new", rows.filter("survey_year >= 1996").drop("forwards"))):
        part.hint("rebalance", "survey_year").write.partitionBy("survey_year").csv(f"{folder}/{name}", header=True, escape='"')
    columns = {"event_id": "string", **RD.MATCH_COLUMNS}
    stacked = RD.read_match_stack(d.spark, [f"{folder}/old", f"{folder}/new"], columns, ["survey_year"])
    return stacked.join(d.archived, "source_name", "left_anti").select(*_STACK_COLUMNS)


def _manifests(d, rows):
    quotes = F.split(F.coalesce("quotes", F.lit("")), ",")
    retriever = F.when(F.col("retriever") != "summary", F.col("retriever"))          # the oldest manifests name none
    models = F.struct(retriever.alias("retriever"), F.lit("embed-1").alias("embed_model"), F.lit("rank-1").alias("rerank_model"))
    params = F.struct(F.lit(3000).alias("top_k"), F.col("rerank_threshold").alias("rerank_threshold"))
    counts = F.struct(F.col("candidates").alias("candidates"), F.col("kept").alias("kept"), F.col("pool").alias("embedded_pool"))
    return rows.select(*RD.manifest_struct(F.col("event_slug"), F.col("event_name"), F.col("survey_year"), F.col("survey_week"), F.col("event_id"), F.col("attention_percentage"),
                                           quotes, F.col("match_start"), F.col("match_end_exclusive"), F.col("built_at"), models, params, counts))


@query("src_manifest_rows", """select event_id, event_slug, event_name, survey_year, survey_week, built_at::varchar as built_at, match_start, match_end_exclusive, retriever, embed_model, rerank_model, 3000 as top_k,
  rerank_threshold, candidates_reranked as candidates, matched_posts_reported as kept, searchable_posts_in_window as embedded_pool from x_datasets""")
def _(d):
    rows = d.datasets.withColumnsRenamed({"candidates_reranked": "candidates", "matched_posts_reported": "kept", "searchable_posts_in_window": "pool"})
    path = run_dir(d.spark, "manifests")
    _manifests(d, rows).write.json(path)
    return RD.manifest_rows(RD.read_manifests(d.spark, path)).drop("attention_text", "quotes")


@query("src_empty_searches", "select s.event_id, s.event_slug, event_name, survey_year, survey_week, 0::bigint as kept from x_empty z join x_survey s using (event_id)")
def _(d):
    rows = d.survey.join(d.empty_searches.select("event_id"), "event_id", "left_semi").select(
        "*", F.lit(None).cast("string").alias("quotes"), F.lit("fulltext").alias("retriever"), F.lit(0.5).alias("rerank_threshold"), F.lit(0).alias("kept"),
        F.lit(100).alias("candidates"), F.lit(0).alias("pool"), F.col("week_end").alias("built_at"))
    path = run_dir(d.spark, "empty-searches")
    _manifests(d, rows).write.json(path)
    return RD.empty_searches(RD.read_manifests(d.spark, path)).select("event_id", "event_slug", "event_name", "survey_year", "survey_week", "kept")


def _config(d, rows, key):
    """Sources listed under a key in lists of at most a thousand, as a config file would name them."""
    number = F.expr("substring(source_name, 2)").cast("long")
    return rows.groupBy(key, F.floor(number / 1000).alias("part")).agg(F.array_sort(F.collect_list("source_name")).alias("sources"))


@query("src_group_map", "select source_name, media_group_key, case when media_group_key = 'asia' then media_group_key else media_group end as media_group, is_grouped from x_groups")
def _(d):
    named = d.groups.select("media_group_key", F.when(F.col("media_group_key") != "asia", F.col("media_group")).alias("label")).distinct()
    config = _config(d, d.groups, "media_group_key").join(named, "media_group_key").withColumnRenamed("media_group_key", "group_key")
    return RD.group_map(config)


@query("src_archived_sources", "select source_name, reason from x_archived")
def _(d):
    lists = _config(d, d.archived, "reason")
    return RD.archived_sources(lists.select(F.create_map("reason", "sources").alias("by_reason")))


@query("src_corpus_union", """with a as (select source_name, message_id::varchar as message_id, published_at from x_posts where line <= 5),
  b as (select source_name, message_id::varchar as message_id, published_at from x_posts where line >= 4 and flag <> 'A')
  select * from a union all select * from b where not exists (select 1 from a where a.source_name = b.source_name and a.message_id = b.message_id)""")
def _(d):
    kind = F.when(F.col("flag") != "A", "text").otherwise("media_only")
    newer = d.posts.filter("line >= 4").select("source_name", "message_id", "published_at", kind.alias("record_type"))
    return RD.corpus_union(d.posts.filter("line <= 5").select("source_name", "message_id", "published_at"), newer)


@query("src_incremental_append", """with e as (select * from x_posts where published_at < timestamp '1998-06-01' - interval 1 day * (length(source_name) * 10)),
  m as (select source_name, max(published_at) as mark from e group by 1)
  select distinct p.source_name, p.message_id from x_posts p left join m using (source_name) where p.published_at >= timestamp '1998-01-01' and (mark is null or p.published_at > mark)
    and (p.source_name, p.message_id) not in (select source_name, message_id from e)""")
def _(d):
    posts = d.posts.select("source_name", "message_id", "published_at")
    stop = F.date_sub(F.lit("1998-06-01").cast("date"), F.length("source_name") * 10).cast("timestamp_ntz")
    arriving = posts.filter(F.col("published_at") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    schema = ", ".join(f"{c} {kind}" for c, kind in posts.dtypes)
    store = PostStore(d.spark, run_dir(d.spark, "posts"), schema, "source_name", "published_at", "message_id").create()
    store.append(posts.filter(F.col("published_at") < stop), "archive")
    store.append(arriving, "collected")
    return store.posts(F.col("batch") == "collected").select("source_name", "message_id")


@query("src_resume_pending", "select doc_id as message_id from documents where doc_id % 3 <> 0 or doc_id % 9 = 0")
def _(d):
    docs = d.table("documents").select(F.col("doc_id").alias("message_id"))
    line = F.concat(F.lit('{"message_id": '), F.col("message_id"), F.when(F.col("message_id") % 9 == 0, "").otherwise(', "on_event": true}'))
    path = run_dir(d.spark, "done")
    docs.filter("message_id % 3 = 0").select(line.alias("value")).write.text(path)
    return RD.pending(docs, RD.read_done_ids(d.spark.read.text(path)))


# ---------------------------------------------------------------------------- profiles
@query("src_input_profile", """select 'rows' as metric, count(*) as value from x_rawsurvey union all select 'blank event names', count(*) filter (where trim(event) = '') from x_rawsurvey
  union all select 'missing percentages', count(*) filter (where percentage is null) from x_rawsurvey union all select 'rows in ' || year, count(*) from x_rawsurvey group by year
  union all select 'posts', count(*) from x_posts union all select 'sources', count(distinct source_name) from x_posts
  union all select 'first day', strftime(min(published_at), '%Y%m%d')::bigint from x_posts union all select 'last day', strftime(max(published_at), '%Y%m%d')::bigint from x_posts""")
def _(d):
    return P.survey_profile(d.raw_survey).unionByName(P.posts_profile(d.posts))


@query("src_column_profile", " union all ".join(
    f"select '{c}' as column_name, count({c}) as filled_rows, count(*) - count({c}) as missing_rows, round(count({c}) * 100::double / count(*), 2) as filled_pct from x_rawmatches"
    for c in ("event_id", "source_name", "message_id", "views", "forwards", "original_message", "rerank_score")))
def _(d):
    return P.column_profile(d.raw_matches.select("event_id", "source_name", "message_id", "views", "forwards", "original_message", "rerank_score"))


@query("src_corpus_stats", " union all ".join(
    f"""select 'by {n}' as kind, strftime(published_at, '{f}') as period, count(*) as rows, count(distinct source_name) as sources, count(summary) as with_summary,
  count(*) filter (where starts_with(original_message, 'plain')) as with_plain_text from x_posts group by 2""" for n, f in (("year", "%Y"), ("month", "%Y-%m")))
  + """ union all select 'digest flag', coalesce(is_digest::varchar, 'missing'), count(*), count(distinct source_name), count(summary), count(*) filter (where starts_with(original_message, 'plain')) from x_posts group by 2
  union all select 'first and last day', source_name, strftime(min(published_at), '%Y%m%d')::bigint, strftime(max(published_at), '%Y%m%d')::bigint, count(*), null from x_posts group by 2""")
def _(d):
    periods = [P.corpus_stats(d.posts, f).select(F.lit(f"by {n}").alias("kind"), "*") for n, f in (("year", "yyyy"), ("month", "yyyy-MM"))]
    n = F.count(F.lit(1))
    flag = d.posts.groupBy(F.coalesce(F.col("is_digest").cast("string"), F.lit("missing")).alias("period"), "source_name").agg(
        n.alias("n"), F.count("summary").alias("s"), F.count_if(F.col("original_message").startswith("plain")).alias("r"))
    flag = flag.groupBy("period").agg(F.sum("n").alias("rows"), n.alias("sources"), F.sum("s").alias("with_summary"), F.sum("r").alias("with_plain_text")).select(
        F.lit("digest flag").alias("kind"), "*")
    day = "cast(date_format({}, 'yyyyMMdd') as bigint)"
    span = d.posts.groupBy("source_name").agg(F.min("published_at").alias("a"), F.max("published_at").alias("b"), n.alias("n")).selectExpr(
        "'first and last day' as kind", "source_name as period", f"{day.format('a')} as rows", f"{day.format('b')} as sources", "n as with_summary", "cast(null as bigint) as with_plain_text")
    return periods[0].unionByName(periods[1]).unionByName(flag).unionByName(span)


@query("src_key_conflicts", """with k as (select source_name, message_id, count(*) as n, count(distinct coalesce(views::varchar, '∅')) as v, count(distinct coalesce(forwards::varchar, '∅')) as f,
    count(distinct coalesce(original_message, '∅')) as o from x_posts group by 1, 2 having count(*) > 1)
  select count(*) as duplicate_keys, count(*) filter (where v > 1) as differing_views, count(*) filter (where f > 1) as differing_forwards, count(*) filter (where o > 1) as differing_original_message from k""")
def _(d):
    return P.key_conflicts(d.posts, ["source_name", "message_id"], ["views", "forwards", "original_message"])


# ---------------------------------------------------------------------------- sinks
@query("sink_dataset_files", """select 'kept_csv' as file, count(*) as rows, sum(post_id)::bigint as id_sum from x_r where score_a >= 0.5 union all
  select 'kept_jsonl', count(*), sum(post_id)::bigint from x_r where score_a >= 0.5 union all select 'candidates_csv', count(*), sum(post_id)::bigint from x_r""")
def _(d):
    ranked = rank_by_score(d.candidates.select("event", "post_id", "score_a", "cos"), ["event"], "score_a", "post_id", 0.0, 1.0)
    paths = SK.write_dataset(ranked, ranked.filter("score_a >= 0.5"), run_dir(d.spark, "dataset"))
    out = None
    for name, path in paths.items():
        back = d.spark.read.json(path) if name.endswith("jsonl") else d.spark.read.csv(path, header=True)
        part = back.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("post_id").cast("long")).alias("id_sum")).select(F.lit(name).alias("file"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("sink_manifest", """select 0.95::double as rerank_threshold, count(*) as candidates, count(*) filter (where k) as kept, count(*) filter (where k and keyword_match) as kept_keyword,
  count(*) filter (where k and not keyword_match) as kept_semantic_only, (count(*) filter (where k and keyword_match))::double / count(*) filter (where keyword_match) as keyword_pool_retention
  from (select *, rerank_score >= 0.95::double as k from x_rawmatches)""", "keyword_pool_retention")
def _(d):
    path = run_dir(d.spark, "run")
    SK.write_run(d.raw_matches, "rerank_score", 0.95, "keyword_match", {"retriever": "fulltext"}, path)
    return d.spark.read.json(f"{path}/manifest").select("params.rerank_threshold", "counts.*")


@query("sink_partitioned_detail", """with g as (select event_id, count(*) as n from x_coverage group by 1), y as (select event_id, count(*) as n, sum(matched_posts)::bigint as m from x_daily group by 1),
  p as (select event_id, count(*) as n from (select event_id, row_number() over (partition by event_id, media_group order by rerank_score desc, published_at, message_id, source_name) as r from x_messages) where r <= 3 group by 1)
  select o.event_id, o.survey_year, coalesce(g.n, 0)::int as n_groups, coalesce(y.n, 0)::int as n_daily, coalesce(p.n, 0)::int as n_posts, coalesce(m, 0) as daily_posts
  from x_overview o left join g using (event_id) left join y using (event_id) left join p using (event_id)""")
def _(d):
    from pyspark.sql import Window
    first = Window.partitionBy("event_id", "media_group").orderBy(F.desc("rerank_score"), "published_at", "message_id", "source_name")
    posts = d.messages.withColumn("place", F.row_number().over(first)).filter("place <= 3").select("event_id", "media_group", "place", "source_name", "message_id", "rerank_score")
    bundles = SK.detail_bundles(d.overview.select("event_id", "survey_year"), {
        "groups": d.coverage.select("event_id", "media_group", "matched_posts", "share_of_voice"),
        "daily": d.daily.select("event_id", "media_group", "coverage_date", "matched_posts"), "posts": posts})
    path = SK.write_partitioned(bundles, run_dir(d.spark, "details"), "survey_year")
    back = d.spark.read.json(path)
    total = F.aggregate("daily", F.lit(0).cast("long"), lambda a, x: a + x["matched_posts"])
    return back.select("event_id", "survey_year", *[F.coalesce(F.size(c), F.lit(0)).alias(f"n_{c}") for c in ("groups", "daily", "posts")], F.coalesce(total, F.lit(0)).alias("daily_posts"))


@query("sink_monthly_text", "select strftime(published_at, '%Y-%m') as month, count(*) as posts, sum(length(original_message))::bigint as characters from x_posts group by 1")
def _(d):
    text = d.posts.select(F.date_format("published_at", "yyyy-MM").alias("month"), F.col("original_message").alias("text"))
    path = SK.write_partitioned(text, run_dir(d.spark, "monthly"), "month", "parquet")
    back = d.spark.read.schema("text string, month string").parquet(path)
    return back.groupBy("month").agg(F.count(F.lit(1)).alias("posts"), F.sum(F.length("text")).alias("characters"))


@query("sink_publish_marts", """select 'event_overview' as mart, (select count(*) from x_overview) as rows union all select 'event_group_coverage', (select count(*) from x_coverage)
  union all select 'week_events', (select count(*) from x_weekevents)""")
def _(d):
    marts = {"event_overview": d.overview, "event_group_coverage": d.coverage, "week_events": d.week_events, "messages": d.messages}
    folder = run_dir(d.spark, "published")
    SK.publish(marts, ["event_overview", "event_group_coverage", "week_events"], folder)
    return SK.published_counts(d.spark, folder)


# ---------------------------------------------------------------------------- preview pages
_NUMBERS = r"""array_to_string(list_transform(regexp_extract_all({x}, '(?s)&#[0-9]+;|&#x[0-9a-f]+;|[^&]+|&'), lambda t: case when t like '&#x%' then chr(('0' || t[3:-2])::int) when t like '&#%;' then chr(t[3:-2]::int) else t end), '')"""
_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(""" + _NUMBERS.format(x=r"""regexp_replace(regexp_replace({x}, '(?i)</?(br|p|blockquote|div)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')""") + r""",
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&hellip;', '…'), '&eacute;', 'é'), '&Auml;', 'Ä'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"""
# Put into some posts and articles, so that nested blocks and references by number and by name are there to read.
_NESTED = '<div class="quote">one <div>two &#1078;&#x2014;&hellip;</div> <b>&eacute; &amp;lt; &#39;</b></div> three &Auml;&nbsp;'
_LOOSE = r"</?(?:b|article|footer|body|html)\b[^>]*>"
_NESTED_SQL = _NESTED.replace("'", "''")


_ARTICLE = f"regexp_extract(html, '(?s)<article>(.*?)</article>', 1) || case when page_id % 3 = 0 then '{_NESTED_SQL}' else '' end"


@query("src_html_text", f"select page_id, md5({_TEXT.format(x=_ARTICLE)}) as digest from pages")
def _(d):
    article = F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1)
    more = F.when(F.col("page_id") % 3 == 0, _NESTED).otherwise("")
    return d.table("pages").select("page_id", F.md5(element_text(F.concat(article, more))).alias("digest"))


def preview_pages(d):
    """Each page's paragraphs dressed as a channel preview: one marked post per paragraph. Previews are well formed, so tags without a partner go."""
    def post(paragraph, i):
        n = F.col("page_id") * 1000 + i + 1
        body = F.regexp_replace(F.regexp_replace(paragraph, r"(?s)</p>.*", ""), _LOOSE, "")
        date = F.when(n % 11 != 0, F.concat(F.lit('<time datetime="2025-01-'), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit('T10:00:00+03:00">'))).otherwise("<time>")
        text = (
            F.when(n % 13 == 0, '<div class="message_photo"></div>').when(n % 17 == 0, '<div class="bubble message_text">Channel created</div>').when(n % 19 == 0, "")
            .when(n % 23 == 0, '<div class="text_not_supported_wrap"></div>').otherwise(F.concat(F.lit('<div class="message_text">'), body, F.when(n % 7 == 0, _NESTED).otherwise(""), F.lit("</div>"))))
        views = F.when(n % 5 != 0, F.concat(F.lit('<span class="message_views">'), ((n % 90) / 10).cast("decimal(4,1)"), F.lit("K</span>"))).otherwise("")
        return F.concat(F.lit('<div class="message" data-post="ch'), F.col("page_id") % 7, F.lit("/"), n, F.lit('">'), date, text, views)
    paragraphs = F.slice(F.split("html", "<p>"), F.lit(2), F.size(F.split("html", "<p>")))
    return d.table("pages").select("page_id", F.concat(F.lit("<html>"), F.array_join(F.transform(paragraphs, post), "</div>")).alias("preview"))


sql_view("x_prev", r"""with p as (select page_id, unnest(string_split(html, '<p>')[2:]) as para, unnest(range(1, len(string_split(html, '<p>')))) as i from pages),
  n as (select page_id, page_id * 1000 + i as n, regexp_replace(regexp_replace(para, '(?s)</p>.*', ''), '""" + _LOOSE + r"""', '', 'g') as body from p),
  t as (select *, case when n % 13 = 0 or (n % 17 <> 0 and (n % 19 = 0 or n % 23 = 0)) then '' when n % 17 = 0 then 'Channel created' else """ + _TEXT.format(x=f"regexp_replace(body, '(?s)</div>.*', '') || case when n % 7 = 0 and not contains(body, '</div>') then '{_NESTED_SQL}' else '' end") + r""" end as text from n)
  select *, case when n % 5 <> 0 then printf('%.1f', (n % 90) / 10) || 'K' end as views_text,
    case when n % 13 = 0 then 'media_only' when n % 17 = 0 then 'service' when n % 19 = 0 then 'empty' when n % 23 = 0 then 'unreadable' when text = '' then 'empty' else 'text' end as record_type from t""")


@query("src_html_posts", """select page_id, n as message_id, 'ch' || page_id % 7 as handle, printf('2025-01-%02dT07:00:00', n % 28 + 1) as published_utc, md5(text) as digest, record_type, n % 13 = 0 as has_media,
  views_text, undated from (select *, count(*) filter (where n % 11 = 0) over (partition by page_id) as undated from x_prev) where n % 11 <> 0""")
def _(d):
    posts, missing = PV.parse_posts(preview_pages(d), "page_id", "preview"), PV.undated(preview_pages(d), "page_id", "preview").select("page_id", "undated")
    return posts.join(missing, "page_id").select("page_id", "message_id", "handle", "published_utc", F.md5("text").alias("digest"), "record_type", "has_media", "views_text", "undated")


@query("prj_views_text", """select page_id, n as message_id, case when n % 3 = 0 then 'many' else coalesce(views_text, '12') end as raw,
  case when n % 3 = 0 then null when views_text is null then 12 else round((n % 90) / 10 * 1000)::bigint end as views from x_prev where n % 11 <> 0""")
def _(d):
    posts = PV.parse_posts(preview_pages(d), "page_id", "preview")
    raw = F.when(F.col("message_id") % 3 == 0, "many").otherwise(F.coalesce("views_text", F.lit("12")))
    return posts.select("page_id", "message_id", raw.alias("raw"), short_count(raw).alias("views"))
