"""Text and vocabulary queries with their checking SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from newsgauge.functions import text as T
from newsgauge.operators import texts as X
from newsgauge.operators import vocabulary as V
from newsgauge.plans.catalog import query, sql_view
from newsgauge.plans.domain import STOPWORDS

_STOPS = ", ".join(f"('{w}')" for w in STOPWORDS)
sql_view("x_stop", f"select * from (values {_STOPS}) as s(term)")
sql_view("x_tposts", """select lang as event_id, lang || case when lang in ('en', 'fr') then '_fulltext' else '' end as event_slug,
  'g' || substr(source, 4)::int % 5 as media_group, source as source_name, doc_id as message_id,
  text || case when doc_id % 2 = 0 then ' read more | ' || source else '' end as post_text from documents""")
sql_view("x_tok", """select md5(post_text) as tid, generate_subscripts(w, 1) as pos, unnest(w) as word from (
  select distinct post_text, regexp_split_to_array(lower(post_text), '[^a-zа-яё0-9]+') as w from x_tposts where post_text is not null)""")
sql_view("x_flag", """select word, word in (select term from x_stop) as is_stopword, regexp_full_match(word, '[0-9]+') as is_number,
  word in (select distinct source_name from x_tposts) as is_source_name from (select distinct word from x_tok where length(word) >= 2)""")
sql_view("x_lemma", """select word, case when length(word) = 4 then left(word, 3) else regexp_replace(word, 's$', '') end as lemma,
  case when length(word) = 4 then 'override' else 'dictionary' end as lemma_source
  from x_flag where not is_stopword and not is_number and not is_source_name and length(word) >= 3""")
sql_view("x_use", """select t.tid, t.pos, t.word, coalesce(l.lemma, t.word) as lemma from x_tok t join x_flag f using (word) left join x_lemma l using (word)
  where length(t.word) >= 2 and not is_stopword and not is_number and not is_source_name""")
sql_view("x_forms", """select tid, 'word' as term_type, lemma as term_key, word as term_form, count(*) as term_uses from x_use where length(word) >= 4 group by all
  union all select a.tid, 'phrase', a.lemma || ' ' || b.lemma, a.word || ' ' || b.word, count(*) from x_use a join x_use b on b.tid = a.tid and b.pos = a.pos + 1
    where length(a.word) >= 3 and length(b.word) >= 3 group by all""")
sql_view("x_pterms", "select tid, term_type, term_key, sum(term_uses)::bigint as term_uses from x_forms group by all")
sql_view("x_pww", """select p.*, md5(post_text) as tid from x_tposts p where md5(post_text) in (select tid from x_tok join x_flag using (word) where not is_source_name)""")
sql_view("x_sterms", """select event_id, media_group, source_name, term_type, term_key, count(*) as posts_with_term, sum(term_uses)::bigint as term_uses
  from x_pww join x_pterms using (tid) group by all""")
sql_view("x_kept", """with g as (select event_id, media_group, event_slug like '%fulltext' as ft, count(*) as gp, count(distinct source_name) as gs from x_pww group by all),
  sp as (select event_id, source_name, count(*) as n from x_pww group by all),
  a as (select event_id, media_group, term_type, term_key, sum(posts_with_term) as p, count(*) as s, sum(term_uses) as u, max(posts_with_term::double / n) as ms,
    max(posts_with_term)::double / sum(posts_with_term) as ts from x_sterms join sp using (event_id, source_name) group by all),
  c as (select a.*, g.gp, g.gs, sum(p) over (partition by a.event_id, term_type, term_key) - p as op,
      (select sum(gp) from g g2 where g2.event_id = a.event_id) - gp as opn,
      sum(p) over (partition by a.media_group, g.ft, term_type, term_key) - p as mp,
      (select sum(gp) from g g3 where g3.media_group = a.media_group and g3.ft = g.ft) - gp as mpn from a join g using (event_id, media_group)),
  r as (select *, p::double / gp as share, op::double / nullif(opn, 0) as oshare, mp::double / nullif(mpn, 0) as mshare from c
    where p >= 3 and gp >= 10 and s >= least(2, gs) and (gs < 3 or ts <= 0.7::double)),
  z as (select *, log2((share + 0.02::double) / (coalesce(oshare, 0) + 0.02::double)) as dist, log2((share + 0.02::double) / (coalesce(mshare, 0) + 0.02::double)) as spec from r)
  select event_id, media_group, term_type, term_key, p::bigint as posts_with_term, s as sources_with_term, u::bigint as term_uses, ms as max_share_within_one_source,
    ts as top_source_share_of_term, gp as group_posts, gs as group_sources, op::bigint as other_posts_with_term, opn::bigint as other_posts, share as share_in_group,
    oshare as share_elsewhere, mshare as share_in_group_other_events, dist as distinctiveness, spec as event_specificity from z where spec >= 0.4""")
sql_view("x_tpo", """select k.event_id, k.media_group, p.source_name, p.message_id, p.tid, k.term_type, k.term_key
  from x_pww p join x_pterms t using (tid) join x_kept k on k.event_id = p.event_id and k.media_group = p.media_group and k.term_type = t.term_type and k.term_key = t.term_key""")
sql_view("x_labels", """with f as (select event_id, media_group, source_name, term_type, term_key, term_form, sum(term_uses) as n from x_tpo join x_forms using (tid, term_type, term_key)
    where term_type = 'phrase' group by all),
  s as (select event_id, media_group, source_name, term_type, term_key, arg_min(term_form, (-n, term_form)) as lab from f group by all)
  select event_id, media_group, term_type, term_key, arg_min(lab, (-posts_with_term, lab)) as term_label from s join x_sterms using (event_id, media_group, source_name, term_type, term_key) group by all
  union all select event_id, media_group, term_type, term_key, term_key from x_kept where term_type = 'word'""")
_SCORE_DOUBLES = ("max_share_within_one_source top_source_share_of_term share_in_group share_elsewhere share_in_group_other_events distinctiveness event_specificity")


@query("txt_tokens", """select tid as post_text_id, pos::int as word_position, word, is_stopword, is_number, is_source_name from x_tok join x_flag using (word)""")
def _(d):
    flags = ["is_stopword", "is_number", "is_source_name"]
    return V.look_up(d.tokens.drop("next_word"), d.lexicon, d.common_words, flags, False).select("post_text_id", "word_position", "word", *flags)


@query("txt_posts_with_words", "select event_id, event_slug, media_group, source_name, message_id, tid as post_text_id from x_pww")
def _(d):
    return d.word_posts


@query("txt_lemmas", "select word, lemma, lemma_source from x_lemma")
def _(d):
    return d.lexicon.filter(F.col("lemma_source").isNotNull()).select("word", "lemma", "lemma_source")


@query("txt_term_forms", "select tid as post_text_id, term_type, term_key, term_form, term_uses from x_forms")
def _(d):
    return d.forms


@query("txt_post_terms", "select tid as post_text_id, term_type, term_key, term_uses from x_pterms")
def _(d):
    return V.each_term(d.terms)


@query("txt_source_terms", "select event_id, media_group, source_name, term_type, term_key, posts_with_term, term_uses from x_sterms")
def _(d):
    return d.source_terms


@query("txt_term_scores", "select * from x_kept", _SCORE_DOUBLES)
def _(d):
    return d.kept_terms


@query("txt_term_posts", "select event_id, media_group, source_name, message_id, tid as post_text_id, term_type, term_key from x_tpo")
def _(d):
    return d.term_posts


@query("txt_term_labels", "select event_id, media_group, term_type, term_key, term_label from x_labels")
def _(d):
    return d.term_labels


@query("txt_term_lists", """select event_id, media_group, term_type, term_key, 0::bigint as part, string_agg(source_name || ':' || message_id, ',' order by source_name || ':' || message_id) as post_keys,
  count(*)::int as n_keys from x_tpo group by all""")
def _(d):
    return V.term_lists(d.term_posts).withColumn("n_keys", F.size("post_keys")).withColumn("post_keys", F.array_join("post_keys", ","))


@query("txt_group_terms", """select k.*, term_label, row_number() over (partition by event_id, media_group, term_type order by distinctiveness desc, posts_with_term desc, term_key) as distinctiveness_rank
  from x_kept k join x_labels using (event_id, media_group, term_type, term_key)""", _SCORE_DOUBLES)
def _(d):
    return V.group_terms(d.kept_terms, d.term_labels)


@query("agg_list", "select event_id, media_group, term_type, term_key, count(*) as posts from x_tpo group by all")
def _(d):
    lists = V.term_lists(d.term_posts)
    return lists.groupBy("event_id", "media_group", "term_type", "term_key").agg(F.sum(F.size("post_keys")).alias("posts"))


@query("agg_arg_min_tuple", """select term_type, term_key, arg_min(term_form, (-n, term_form)) as spelling from (select term_type, term_key, term_form, sum(term_uses) as n from x_forms group by all) group by all""")
def _(d):
    uses = d.forms.groupBy("term_type", "term_key", "term_form").agg(F.sum("term_uses").alias("n"))
    return uses.groupBy("term_type", "term_key").agg(F.min_by("term_form", F.struct(-F.col("n"), F.col("term_form"))).alias("spelling"))


@query("join_adjacent_bigram", """select a.tid as post_text_id, a.word, b.word as next_word, count(*) as uses from x_tok a join x_tok b on b.tid = a.tid and b.pos = a.pos + 1
  where length(a.word) >= 2 and length(b.word) >= 2 group by all""")
def _(d):
    return V.pair_counts(d.split, 2, "uses")


@query("join_multi_key", "select event_id, media_group, term_type, term_key, posts_with_term, other_posts_with_term, other_posts, share_in_group_other_events from x_kept", "share_in_group_other_events")
def _(d):
    return d.kept_terms.select("event_id", "media_group", "term_type", "term_key", "posts_with_term", "other_posts_with_term", "other_posts", "share_in_group_other_events")


@query("join_combined_hash", "select event_id, media_group, term_type, term_key, count(*) as posts from x_tpo group by all")
def _(d):
    return V.term_posts(d.word_posts, V.post_terms(d.listed), d.kept_terms).groupBy("event_id", "media_group", "term_type", "term_key").agg(F.count(F.lit(1)).alias("posts"))


@query("join_text_hash", """select event_id, message_id, tid as post_text_id, count(*) as words from x_pww join x_tok using (tid) where length(word) >= 2 group by all""")
def _(d):
    return d.word_posts.join(V.text_lengths(d.split), "post_text_id").groupBy("event_id", "message_id", "post_text_id").agg(F.sum("words").alias("words"))


@query("join_unnest_semi", """select event_id, source_name, message_id from x_tposts where source_name || ':' || message_id in
  (select source_name || ':' || message_id from x_tpo join x_labels using (event_id, media_group, term_type, term_key) where term_type = 'phrase')""")
def _(d):
    keys = V.term_lists(d.term_posts).filter("term_type = 'phrase'").select(F.explode("post_keys").alias("k"))
    return d.texts.withColumn("k", F.concat_ws(":", "source_name", "message_id")).join(keys, "k", "left_semi").select("event_id", "source_name", "message_id")


# ---------------------------------------------------------------------------- running text
@query("prj_text_normalise", """with n as (select message_id, source_name, topic, trim(coalesce(original_message, '')) as t, summary from x_posts),
  m as (select *, case when starts_with(t, '{') and json_valid(t) and trim(coalesce(json_extract_string(t, '$.message'), '')) <> '' then trim(json_extract_string(t, '$.message')) else t end as b from n),
  f as (select *, case when b = '' then trim(coalesce(summary, '')) else b end as c from m)
  select message_id, source_name, topic, case when length(c) > 20 then rtrim(left(c, 20)) || ' …' else c end as text from f""")
def _(d):
    return d.posts.select("message_id", "source_name", "topic", T.normalise_text(F.col("original_message"), F.col("summary"), 20).alias("text"))


@query("prj_keyword_match", r"""select doc_id, regexp_matches(text, '(?i)étion|straße|that\s+is') or coalesce(regexp_matches(source, '(?i)étion|straße|that\s+is'), false) as hit from documents""")
def _(d):
    return d.table("documents").select("doc_id", T.keyword_match(r"étion|straße|that\s+is", F.col("text"), F.col("source")).alias("hit"))


@query("prj_keyword_search", """select source_name, message_id, topic, published_at from x_posts where published_date >= date '1996-03-01' and published_date < date '1996-06-01'
  and (lower(summary) like '%part 1%' or lower(original_message) like '%post r%' or lower(summary) like '%part 77%')
  order by published_at, source_name, message_id, topic limit 500""")
def _(d):
    from newsgauge.operators.retrieval import keyword_search
    return keyword_search(d.posts, "1996-03-01", "1996-06-01", {"summary": ["part 1", "part 77"], "original_message": ["post r"]}, 500).select(
        "source_name", "message_id", "topic", "published_at")


@query("prj_clean_text", r"""select doc_id, md5(trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(text, '(?i)(https?://\S+|t\.me/\S+|www\.\S+)', ' ', 'g'),
  '(^|[^\pL\pN_])@[\pL\pN_]+', '\1 ', 'g'), '#', ' '), '[\p{So}\p{Sk}\p{Cs}\p{Co}\p{Cf}]', '', 'g'), '\s+', ' ', 'g'))) as digest from documents""")
def _(d):
    return d.table("documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("digest"))


@query("prj_fragments", """with s as (select doc_id, text, unnest(generate_series(0, greatest(ceil((length(text) - 650) / 530), 0)::bigint)) as i from documents where length(text) > 0)
  select doc_id, i::int as fragment, substring(text, i * 530 + 1, 650) as piece from s""")
def _(d):
    return d.table("documents").select("doc_id", F.posexplode(T.fragments(F.col("text"))).alias("fragment", "piece"))


sql_view("x_sq", r"select source_name, '2025-0' || (message_id % 2 + 1) as month, message_id, trim(regexp_replace(post_text, '\s+', ' ', 'g')) as t from x_tposts")
sql_view("x_foot", """with e as (select source_name, month, array_to_string(w[-k:], ' ') as ending from (select source_name, month, string_split(t, ' ') as w, unnest(generate_series(2, 25)) as k from x_sq) where len(w) > k),
  c as (select source_name, month, ending, count(*) as posts_ending from e group by all)
  select source_name, month, ending, posts_ending, ending like '%@%' or ending like '%t.me%' or ending like '%http%' or ending like '%|%' or ending like '%¦%' or lower(ending) like '%subscribe%' as has_marker,
    posts_ending / n as share from c join (select source_name, month, count(*) as n from x_sq group by 1, 2) using (source_name, month)
  where posts_ending >= greatest(20, 0.05 * n) and (has_marker or posts_ending / n >= 0.3)""")


@query("prj_footer_detect", "select * from x_foot", "share")
def _(d):
    return d.footers


_STRIP = "\n".join(f"""{'' if i == 1 else ','} p{i} as (select source_name, message_id, case when e is null then t else rtrim(left(t, length(t) - length(e)), ' |¦-–—:•·') end as t from (
  select p.source_name, p.message_id, any_value(p.t) as t, arg_max(f.ending, length(f.ending)) as e from {'x_sq' if i == 1 else f'p{i - 1}'} p left join (select distinct ending from x_foot) f
    on ends_with(p.t, f.ending) and length(p.t) > length(f.ending)
    and array_to_string(string_split(p.t, ' ')[-2:], ' ') = array_to_string(string_split(f.ending, ' ')[-2:], ' ') group by 1, 2))""" for i in range(1, 5))


@query("prj_footer_strip", f"with {_STRIP} select message_id, md5(t) as digest, length(t)::int as chars from p4")
def _(d):
    done = X.strip_footers(d.squeezed, "message_id", "t", d.footers)
    return done.select("message_id", F.md5("t").alias("digest"), F.length("t").alias("chars"))


sql_view("x_turn", """select doc_id, g, cost, turn, row_number() over (order by turn, g) as place from (select doc_id, 'g' || substr(source, 4)::int % 5 as g,
  floor(length(text) / 2.2::double)::bigint + 2125 as cost, row_number() over (partition by substr(source, 4)::int % 5 order by doc_id) as turn from documents)""")


def _turns(d):
    rows = d.table("documents").select("doc_id", F.concat(F.lit("g"), F.expr("substring(source, 4)").cast("int") % 5).alias("g"), T.estimated_tokens(F.col("text")).alias("cost"))
    return X.interleave(rows, "g", "doc_id")


@query("prj_interleave", "select doc_id, g, cost, turn, place from x_turn")
def _(d):
    return _turns(d).select("doc_id", "g", "cost", "turn", "place")


@query("prj_budget_trim", "select * from (select doc_id, place, sum(cost) over (order by place)::bigint as running_cost from x_turn) where running_cost <= 950000")
def _(d):
    return X.trim_to_budget(_turns(d), "place", "cost", 950_000).select("doc_id", "place", "running_cost")


@query("txt_dup_share", r"""select lang, (count(*) - count(distinct lower(trim(regexp_replace(text, '\s+', ' ', 'g')))))::double / count(*) as repeat_share from documents group by 1""", "repeat_share")
def _(d):
    return X.repeat_share(d.table("documents"), ["lang"], "text")


@query("txt_top_terms_latin", """with w as (select lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as word from documents)
  select * from (select lang, word, count(*) as uses, row_number() over (partition by lang order by count(*) desc, word) as place from w where word not in (select term from x_stop) group by lang, word) where place <= 6""")
def _(d):
    return X.top_words(d.table("documents"), ["lang"], "text", d.stopwords, 6)


@query("txt_medoid_jaccard", r"""with r as (select lang, doc_id, trim(regexp_extract(text, '^[^.]*\.')) as p from documents),
  c as (select lang, lower(p) as l, arg_min(p, doc_id) as phrase, min(doc_id) as doc_id from r where length(p) between 24 and 170 group by 1, 2),
  w as (select *, list_distinct(string_split(trim(regexp_replace(l, '\s+', ' ', 'g')), ' ')) as ws from c),
  s as (select a.lang, a.doc_id, a.phrase, round(sum(len(list_intersect(a.ws, b.ws))::double / len(list_distinct(list_concat(a.ws, b.ws)))), 9) as overlap from w a join w b on a.lang = b.lang group by all)
  select lang, arg_max(doc_id, (overlap, -doc_id)) as doc_id, arg_max(phrase, (overlap, -doc_id)) as phrase, max(overlap) as overlap from s group by 1""", "overlap")
def _(d):
    rows = d.table("documents").select("lang", "doc_id", F.regexp_extract("text", r"^[^.]*\.", 0).alias("p"))
    return X.typical_phrase(rows, ["lang"], "doc_id", "p")
