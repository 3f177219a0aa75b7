"""Framing comparison queries with their checking SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from newsgauge.operators import clusters as CL
from newsgauge.operators import contingency as CT
from newsgauge.operators import framing as FR
from newsgauge.operators import texts as X
from newsgauge.plans.catalog import query, sql_view

GROUPS = ["g0", "g1", "g2", "g3", "g4"]


def H(salt: str, n: int, *more: str) -> str:
    key = " || '|' || ".join([f"'{salt}'", *more, "doc_id"])
    return f"(('0x' || substr(md5({key}), 1, 8))::bigint % {n})"


_G = "(substr(source, 4)::int % 5)"
_ROLES = "[" + ", ".join(f"'{r}'" for r in FR.ROLES) + "]"
_APPROVE = ", ".join(f"'{r}'" for r in FR.APPROVING)
_CONDEMN = ", ".join(f"'{r}'" for r in FR.CONDEMNING)
_CAT = f"case when role in ({_APPROVE}) then 'favourable' when role in ({_CONDEMN}) then 'unfavourable' when role = 'victim' then 'victim' else 'neutral' end"
_FR = ", ".join(f"{H('sem', 100, f'{i}')} < {20 + 10 * i} + 4 * {_G} as {f}" for i, f in enumerate(FR.FRAMES))
_STAT = "['asserted','asserted','asserted','asserted','asserted','attributed','attributed','hedged','denied','questioned']"
sql_view("x_allrec", f"""select lang as event, doc_id as message_id, doc_id, source, text, 'g' || {_G} as media_group, {_G} as g, case when {H('on', 20)} > 0 then {H('on', 20)} <> 1 end as on_event,
  {_STAT}[(({H('ep', 10)} + {_G}) % 10 + 1)::int] as status, 'n' || ({H('nar', 10)} + {_G}) % 4 as narrative_id, case when {H('cc', 3)} <> 0 then 'actor' || {H('ce', 8)} end as cause,
  trim(regexp_extract(text, '^[^.]*\\.')) as first, case when {H('tr', 3)} <> 0 then trim(regexp_extract(text, '^[^.]*\\.')) end as treatment, {_FR} from documents""")
sql_view("x_rec", "select * from x_allrec where coalesce(on_event, true)")
_N3 = "unnest(range(1, {n} + 1)) as i"
sql_view("x_lab2", f"""select event, media_group, message_id, i, 'term' || {H('at', 12, 'i')} as term, ['positive', 'negative', 'neutral'][(({H('av', 4, 'i')} + g) % 3 + 1)::int] as valence
  from (select *, unnest(range(1, {H('na', 4)} + 1)) as i from x_rec)""")
sql_view("x_allmen", f"""select event, media_group, message_id, on_event, status, i, 'actor' || {H('me', 6, 'i')} as entity, {_ROLES}[(({H('mr', 6, 'i')} * 3 + g) % 18 + 1)::int] as role,
  case when {H('mx', 10, 'i')} <> 0 then {H('mp', 7, 'i')} - 3 end as polarity, {H('mi', 4, 'i')} as intensity from (select *, unnest(range(1, {H('nm', 4)} + 1)) as i from x_allrec)""")
sql_view("x_men", "select *, case when polarity is not null then greatest(least(polarity, 2), -2) end as pol from x_allmen where coalesce(on_event, true)")
sql_view("x_ent", f"""select event, media_group, message_id, on_event, i, 'actor' || {H('en', 8, 'i')} as entity, ['person', 'org', 'place'][({H('et', 3, 'i')} + 1)::int] as type
  from (select *, unnest(range(1, {H('ne', 3)} + 2)) as i from x_allrec)""")
sql_view("x_gn", "select event, media_group, count(*) as group_n from x_rec group by all")


@query("src_nested_jsonl", "select event, message_id, media_group, status as epistemic_status, coalesce(on_event, true) as on_event from x_rec")
def _(d):
    from newsgauge.sources.readers import read_records
    from newsgauge.session import run_dir
    path = run_dir(d.spark, "records-jsonl")
    d.all_records.write.json(path)
    return read_records(d.spark, path).select("event", "message_id", "media_group", "epistemic_status", F.coalesce("on_event", F.lit(True)).alias("on_event"))


@query("prj_entity_alias", """with a as (select message_id, i, case entity when 'actor1' then 'Actor One' when 'actor2' then 'Actor One' else entity end as entity from x_men)
  select message_id, string_agg(entity, ',' order by i) as cast_names from a group by 1""")
def _(d):
    mapped = FR.canonical_entities(d.records, {"actor1": "Actor One", "actor2": "Actor One", "actor9": "Actor Nine"})
    return mapped.filter(F.size("moral_evaluation") > 0).select("message_id", F.array_join(F.transform("moral_evaluation", lambda m: m["entity"]), ",").alias("cast_names"))


@query("prj_clip_score", "select message_id, i::int as i, pol::int as polarity from x_men")
def _(d):
    return d.records.select("message_id", F.posexplode("moral_evaluation").alias("i", "m")).select(
        "message_id", (F.col("i") + 1).alias("i"), FR.clipped(F.col("m.polarity")).alias("polarity"))


@query("prj_signature", """select r.message_id, concat_ws(' | ', nullif(first, ''), 'labels: ' || l, 'cause: ' || cause, 'roles: ' || m, 'epistemic: ' || status) as signature from x_rec r
  left join (select message_id, string_agg(term, ', ' order by i) as l from x_lab2 group by 1) a using (message_id)
  left join (select message_id, string_agg(entity || '=' || role, '; ' order by i) as m from x_men group by 1) b using (message_id)""")
def _(d):
    return d.records.select("message_id", FR.signature(d.records).alias("signature"))


@query("prj_explorer_slim", """select r.message_id as id, media_group as grp, concat_ws(',', """ + ", ".join(f"case when {f} then '{f}' end" for f in FR.FRAMES) + """) as frames,
  coalesce(n, 0)::int as n_roles from x_rec r left join (select message_id, count(*) as n from x_men group by 1) using (message_id)""")
def _(d):
    slim = d.records.select(*FR.slim_record())
    return slim.select("id", "grp", F.array_join("sem", ",").alias("frames"), F.size("me").alias("n_roles"))


sql_view("x_nar", """select event, media_group, narrative_id, count(*) as k, group_n as n, count(*)::double / group_n as p from x_rec join x_gn using (event, media_group)
  where narrative_id is not null group by event, media_group, narrative_id, group_n""")
sql_view("x_binom", """select event, media_group, narrative_id, n, k, p, x, sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(p) + (n - x) * ln(1 - p))) over (partition by event, media_group, narrative_id order by x) as below
  from (select *, unnest(range(0, n + 1)) as x from x_nar where p < 1)""")


@query("frm_narrative_share_ci", """with q as (select event, media_group, narrative_id, min(x) filter (where below >= 0.025) as lo, coalesce(min(x) filter (where below >= 0.975), any_value(n)) as hi from x_binom group by all)
  select event, media_group, narrative_id, n, round_even(p, 3) as share, coalesce(lo, n)::double / n as exact_lo, coalesce(hi, n)::double / n as exact_hi, true as close, n < 30 as directional_only
  from x_nar left join q using (event, media_group, narrative_id)""", "exact_lo exact_hi")
def _(d):
    return FR.interval_checks(FR.share_intervals(d.records), FR.narrative_counts(d.records))


sql_view("x_js", """with g as (select event, media_group, narrative_id, count(*) as n from x_rec group by all),
  f as (select a.event, b.media_group, a.narrative_id, coalesce(n, 0) as n from (select distinct event, narrative_id from g) a join (select distinct event, media_group from g) b using (event)
    left join g on g.event = a.event and g.media_group = b.media_group and g.narrative_id = a.narrative_id),
  p as (select *, n::double / sum(n) over (partition by event, media_group) + 1e-12 as p0 from f), q as (select *, p0 / sum(p0) over (partition by event, media_group) as p from p)
  select a.event, a.media_group as group_a, b.media_group as group_b, sqrt(sum(a.p * log2(a.p / ((a.p + b.p) / 2)) + b.p * log2(b.p / ((a.p + b.p) / 2))) / 2) as js_distance
  from q a join q b on a.event = b.event and a.narrative_id = b.narrative_id and a.media_group < b.media_group group by all""")


@query("frm_js_divergence", "select * from x_js", "js_distance")
def _(d):
    return FR.group_distances(FR.narrative_counts(d.records), "narrative_id")


@query("frm_js_summary", """select event, media_group, avg(js_distance) as mean_js_distance, max(js_distance) as max_pair_distance from (select event, unnest([group_a, group_b]) as media_group, js_distance from x_js)
  group by all""", "mean_js_distance max_pair_distance")
def _(d):
    return FR.distance_summary(FR.group_distances(FR.narrative_counts(d.records), "narrative_id"))


sql_view("x_cont", "select event, media_group, entity, role, count(*) as n from x_men group by all")


@query("frm_role_contingency", "select *, n::double / sum(n) over (partition by event, media_group, entity) as share_in_group_entity from x_cont", "share_in_group_entity")
def _(d):
    return FR.role_contingency(d.records)


@query("frm_role_flips", f"""with d as (select event, media_group, entity, arg_min(role, (-n, role)) as role, sum(n)::bigint as s from x_cont group by all having sum(n) >= 3)
  select event, entity, count(*) as n_groups, bool_or(role in ({_APPROVE}, 'victim')) and bool_or(role in ({_CONDEMN})) as opposed_contradiction,
    string_agg(media_group || ': ' || role || ' (' || s || ')', '; ' order by media_group || ': ' || role || ' (' || s || ')') as assignments
  from d group by all having count(*) >= 2 and count(distinct role) >= 2""")
def _(d):
    return FR.role_flips(FR.role_contingency(d.records))


@query("frm_lexicon", """select * from (select event, media_group, term, valence, count(*) as n, row_number() over (partition by event, media_group order by count(*) desc, term, valence) as place from x_lab2
  group by event, media_group, term, valence) where place <= 15""")
def _(d):
    counts = FR.labels(d.records).groupBy("event", "media_group", "term", "valence").agg(F.count(F.lit(1)).alias("n"))
    ranked = FR.top_within(counts.withColumn("_k", F.struct("term", "valence")), FR.EG, "_k", 15)
    return ranked.drop("_k")


@query("agg_top_k_per_group", """select *, n::double / t as share from (select event, media_group, term, count(*) as n, sum(count(*)) over (partition by event, media_group)::bigint as t,
  row_number() over (partition by event, media_group order by count(*) desc, term) as place from x_lab2 group by event, media_group, term) where place <= 3""", "share")
def _(d):
    counts = FR.labels(d.records).groupBy("event", "media_group", "term").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*FR.EG).agg(F.sum("n").alias("t"))
    return FR.top_within(counts, FR.EG, "term", 3).join(totals, FR.EG).withColumn("share", F.col("n").cast("double") / F.col("t"))


@query("frm_epistemic", "select event, media_group, status as epistemic_status, count(*) as n, round_even(count(*)::double / sum(count(*)) over (partition by event, media_group), 3) as share from x_rec group by event, media_group, status")
def _(d):
    counts = d.records.groupBy(*FR.EG, "epistemic_status").agg(F.count(F.lit(1)).alias("n"))
    return FR.share_within(counts, FR.EG).withColumn("share", F.bround("share", 3))


@query("agg_crosstab_norm", "select event, media_group, " + ", ".join(f"(count(*) filter (where status = '{s}'))::double / count(*) as {s}" for s in FR.STATUSES) + " from x_rec group by 1, 2", " ".join(FR.STATUSES))
def _(d):
    counts = d.records.groupBy(*FR.EG).pivot("epistemic_status", FR.STATUSES).agg(F.count(F.lit(1)))
    row = sum((F.coalesce(F.col(s), F.lit(0)) for s in FR.STATUSES[1:]), F.coalesce(F.col(FR.STATUSES[0]), F.lit(0)))
    return counts.select(*FR.EG, *[(F.coalesce(F.col(s), F.lit(0)).cast("double") / row).alias(s) for s in FR.STATUSES])


@query("frm_causal_top", """select event, media_group, cause as cause_entity, n, place, round_even(n::double / group_n, 3) as share from (select event, media_group, cause, count(*) as n,
  row_number() over (partition by event, media_group order by count(*) desc, cause) as place from x_rec where cause is not null group by event, media_group, cause) join x_gn using (event, media_group) where place <= 6""")
def _(d):
    return FR.top_causes(d.records)


@query("frm_semetko", " union all ".join(f"select event, media_group, '{f}' as frame, round_even(avg({f}::int), 3) as share from x_rec group by 1, 2" for f in FR.FRAMES))
def _(d):
    return FR.frame_prevalence(d.records)


_PRESENCE = """with s as (select distinct event, media_group, message_id, entity from x_ent where coalesce(on_event, true)), t as (select event, entity, row_number() over (partition by event order by count(*) desc, entity) as r from s group by event, entity)
  select g.event, g.media_group, t.entity, round_even((select count(*) from s where s.event = g.event and s.media_group = g.media_group and s.entity = t.entity)::double / group_n, 3) as share
  from x_gn g join t on t.event = g.event and r <= {k}"""


@query("frm_entity_presence", _PRESENCE.format(k=20))
def _(d):
    return FR.entity_presence(d.records)


@query("agg_presence", _PRESENCE.format(k=5))
def _(d):
    return FR.entity_presence(d.records, top=5)


_DIMS = f"""select event, media_group, 'Epistemic status' as dimension, 'message' as unit, status as category, count(*) as n from x_rec group by all
  union all select event, media_group, 'Prescribes a remedy', 'message', case when treatment <> '' then 'prescribes' else 'none' end, count(*) from x_rec group by all
  """ + "".join(f"union all select event, media_group, 'Frame · {f}', 'message', case when {f} then 'uses' else '—' end, count(*) from x_rec group by all\n  " for f in FR.FRAMES) + f"""
  union all select event, media_group, 'Action-label valence', 'loaded term', valence, count(*) from x_lab2 group by all
  union all select event, media_group, 'Role type (overall cast)', 'role assignment', {_CAT}, count(*) from x_men group by all
  union all select event, media_group, 'Cast of: ' || entity, 'role assignment', {_CAT}, count(*) from x_men where entity in ('actor1', 'actor2') group by all
  union all select event, media_group, 'Blamed entity (cause)', 'msg w/ cause', case when (event, cause) in (select event, cause from (select event, cause, row_number() over (partition by event order by count(*) desc, cause) as r
    from x_rec where cause is not null group by event, cause) where r <= 5) then cause else '(other)' end, count(*) from x_rec where cause is not null group by all"""
_DIMS += " union all select event, media_group, 'problem_definition cluster', 'message', 'C' || label, count(*) from x_rec join x_vec on id = message_id group by all"
sql_view("x_dims", f"select * from ({_DIMS}) where (event, media_group) in (select event, media_group from x_gn where group_n >= 15)")
sql_view("x_chi", """with c as (select event, dimension, category, media_group, sum(n) as n from x_dims group by all), r as (select event, dimension, category, sum(n) as r from c group by all),
  k as (select event, dimension, media_group, sum(n) as c from c group by all), s as (select event, dimension, count(*) as nr, sum(r) as t from r group by all), z as (select event, dimension, count(*) as nc from k group by all),
  g as (select r.event, r.dimension, nr, nc, t, coalesce(c.n, 0)::double as o, r.r::double * k.c / t as e from r join k using (event, dimension) join s using (event, dimension) join z using (event, dimension)
    left join c on c.event = r.event and c.dimension = r.dimension and c.category = r.category and c.media_group = k.media_group where nr > 1 and nc > 1),
  y as (select *, abs(o - e) - case when (nr - 1) * (nc - 1) = 1 then least(0.5::double, abs(o - e)) else 0 end as d from g)
  select event, dimension, t::bigint as n, sum(d * d / e) as chi2, (nr - 1) * (nc - 1) as dof, sqrt(sum(d * d / e) / (t * (least(nr, nc) - 1))) as v, min(e) as min_expected, avg((e < 5)::int) as share_below_5
  from y group by event, dimension, t, nr, nc""")
# P(X >= chi2). Even degrees: a finite sum. Odd: erfc(z) with z = sqrt(chi2 / 2), from the series of erf with positive terms only, and a finite sum.
sql_view("x_tests", """select *, case when chi2 <= 0 then 1.0 when chi2 > 600 then 0.0
  when dof % 2 = 0 then exp(-chi2 / 2) * (select sum(pow(chi2 / 2, i) / factorial(i::int)) from range(0, 30) r(i) where i < dof // 2)
  else greatest(0.0, 1 - 2 / sqrt(pi()) * (select sum(exp(2 * n * ln(2) + (2 * n + 1) * ln(sqrt(chi2 / 2)) - lgamma(2 * n + 2) + lgamma(n + 1) - chi2 / 2)) from range(0, 900) r(n)))
    + sqrt(2 * chi2 / pi()) * exp(-chi2 / 2) * coalesce((select sum(exp((j - 1) * ln(chi2) - lgamma(2 * j + 1) + j * ln(2) + lgamma(j + 1))) from range(1, 60) r(j) where j <= (dof - 1) // 2), 0) end as p from x_chi""")
sql_view("x_holm", """with r as (select *, row_number() over (partition by event order by p, dimension) as k, count(*) over (partition by event) as m from x_tests)
  select *, max(least(1, (m - k + 1) * p)) over (partition by event order by p, dimension rows unbounded preceding) as p_holm from r""")


def _dims(d):
    return FR.dimensions(d.records, ["actor1", "actor2"], clusters={"problem_definition": d.vectors.select(F.col("id").alias("message_id"), F.col("label").alias("cluster"))})


@query("frm_dimensions", "select * from x_dims")
def _(d):
    return _dims(d)


@query("frm_chi2", "select * from x_chi", "chi2 v min_expected share_below_5", digits=7)
def _(d):
    return CT.chi_square(_dims(d))


def _tests(d):
    return CT.with_p(CT.chi_square(_dims(d)))


@query("frm_holm", "select event, dimension, chi2, dof, p, p_holm from x_holm", "chi2 p p_holm", digits=7)
def _(d):
    return CT.holm(_tests(d)).select("event", "dimension", "chi2", "dof", "p", "p_holm")


@query("frm_association_leaderboard", """select event, dimension, n, dof, v, p_holm, share_below_5 > 0.2 as thin, case when p_holm < 0.001 then '***' when p_holm < 0.01 then '**' when p_holm < 0.05 then '*' else 'ns' end as stars,
  row_number() over (partition by event order by round(v, 12) desc, dimension) as place from x_holm""", "v p_holm", digits=7)
def _(d):
    return CT.leaderboard(_tests(d)).select("event", "dimension", "n", "dof", "v", "p_holm", "thin", "stars", "place")


@query("frm_distributions", f"""with roles as (select event, media_group, 'role' as field, role as value, count(*)::double / sum(count(*)) over (partition by event, media_group) as share from x_men group by event, media_group, role),
  val as (select event, media_group, 'valence' as field, valence as value, count(*)::double / sum(count(*)) over (partition by event, media_group) as share from x_lab2 group by event, media_group, valence),
  epi as (select event, media_group, 'epistemic' as field, status as value, count(*)::double / sum(count(*)) over (partition by event, media_group) as share from x_rec group by event, media_group, status),
  top as (select event, entity, row_number() over (partition by event order by count(*) desc, entity) as r from x_men group by event, entity),
  st as (select event, media_group, 'stance', entity, avg(pol) from x_men join top using (event, entity) where r <= 6 group by all having count(pol) >= 3)
  select * from epi union all select * from val union all select * from roles union all select * from st
  union all select event, media_group, 'intensity', 'mean', avg(intensity) from x_men group by all
  union all select event, media_group, 'remedy', 'prescribes', avg((coalesce(treatment, '') <> '')::int) from x_rec group by all
  union all select event, media_group, 'cause', 'named', avg((cause is not null)::int) from x_rec group by all
  union all select g.event, g.media_group, 'entities', 'per message', (select count(*) from x_ent e where e.event = g.event and e.media_group = g.media_group and coalesce(on_event, true))::double / group_n from x_gn g
  """ + " ".join(f"union all select event, media_group, 'frame', '{f}', avg({f}::int) from x_rec group by all" for f in FR.FRAMES), "share")
def _(d):
    from newsgauge.operators.distributions import all_fields
    return all_fields(d.records)


@query("frm_within_event", f"""with b as (select event, media_group from x_gn where group_n >= 15), r as (select * from x_rec where (event, media_group) in (select * from b)),
  m as (select event, media_group, 'own voice' as measure, round_even(avg((status = 'asserted')::int) * 100, 0) as value from r group by all
    union all select event, media_group, 'human interest', round_even(avg(human_interest::int) * 100, 0) from r group by all
    union all select event, media_group, 'morality', round_even(avg(morality::int) * 100, 0) from r group by all
    union all select b.event, b.media_group, 'positive terms', coalesce(round_even(avg((valence = 'positive')::int) * 100, 0), 0) from b left join x_lab2 l on l.event = b.event and l.media_group = b.media_group group by all
    union all select event, media_group, 'stance: ' || entity, avg(pol) from x_men where (event, media_group) in (select * from b) and (event, entity) in (select event, entity from
      (select event, entity, row_number() over (partition by event order by count(*) desc, entity) as k from x_men group by event, entity) where k <= 4) group by event, media_group, entity having count(pol) >= 3),
  s as (select event, measure, count(*) as groups, max(value) - min(value) as spread from m group by all having count(*) >= 2)
  select *, case when measure like 'stance%' then case when round(spread, 9) >= 0.7 then 'STRONG' when round(spread, 9) >= 0.3 then 'some' else 'little' end
    else case when spread >= 25 then 'STRONG' when spread >= 10 then 'some' else 'little' end end as verdict from s""", "spread")
def _(d):
    return FR.within_event(d.records)


sql_view("x_stance", """with m as (select * from x_men where polarity is not null), o as (select event, entity from m group by all having count(*) >= 20),
  t as (select event, media_group, entity, role, count(*) as n, row_number() over (partition by event, media_group, entity order by count(*) desc, role) as k from m group by event, media_group, entity, role)
  select event, media_group, entity, count(*) as n, round_even(sum(pol)::double / count(*), 2) as mean_polarity, round_even((count(*) filter (where status = 'attributed'))::double / count(*), 2) as share_quoted,
    (select string_agg(role || ' ' || t.n, ', ' order by k) from t where t.event = m.event and t.media_group = m.media_group and t.entity = m.entity and k <= 2) as top_roles
  from m where (event, entity) in (select * from o) group by event, media_group, entity""")


@query("frm_actor_stance", "select * from x_stance")
def _(d):
    return FR.actor_stance(d.records, 20)


@query("frm_polarity_wide", "select event, entity, " + ", ".join(f"coalesce(max(case when media_group = '{g}' then printf('%+.1f', mean_polarity) || ' (' || n || ')' end), '—') as {g}" for g in GROUPS)
       + ", sum(n)::bigint as total_n from x_stance group by 1, 2")
def _(d):
    return FR.polarity_wide(FR.actor_stance(d.records, 20), GROUPS)


@query("frm_share_table", """with c as (select event, media_group, term, count(distinct message_id) as m, count(*) as k from x_lab2 group by all), t as (select event, media_group, sum(k) as a from c group by all),
  f as (select x.event, g.media_group, x.term, coalesce(m, 0)::double / group_n as message_share, coalesce(k, 0)::double / greatest(coalesce(a, 0), 1) as item_share
    from (select distinct event, term from c) x join x_gn g using (event) left join c on c.event = x.event and c.media_group = g.media_group and c.term = x.term left join t on t.event = x.event and t.media_group = g.media_group)
  select *, max(message_share) over (partition by event, term) - min(message_share) over (partition by event, term) as spread from f""", "message_share item_share spread")
def _(d):
    return FR.share_table(FR.labels(d.records), FR.group_sizes(d.records), "term")


@query("frm_cast_matrix", f"""with b as (select event, media_group from x_gn where group_n >= 15),
  t as (select event, entity, row_number() over (partition by event order by count(*) desc, entity) as r from x_men group by event, entity),
  p as (select event, media_group, entity, r, avg(pol) as mean_polarity, count(pol) as n from x_men join t using (event, entity) where r <= 20 and (event, media_group) in (select * from b) group by all having count(pol) >= 2),
  k as (select event, media_group, entity, role, {_CAT} as cat, count(*) as c, row_number() over (partition by event, media_group, entity order by count(*) desc, role) as o from x_men group by event, media_group, entity, role),
  v as (select event, entity, r, row_number() over (partition by event order by r) as q from (select event, entity, r, count(*) as cov from p group by all) join (select event, count(*) as ng from b group by 1) using (event)
    where cov >= greatest(3, ng // 2)),
  c as (select p.event, p.media_group, p.entity, a.role, a.cat, case when z.c >= a.c * 0.6::double and z.cat <> a.cat then z.role end as second_role, mean_polarity, n from p join v on v.event = p.event and v.entity = p.entity and q <= 7
    left join k a on a.event = p.event and a.media_group = p.media_group and a.entity = p.entity and a.o = 1 left join k z on z.event = p.event and z.media_group = p.media_group and z.entity = p.entity and z.o = 2)
  select event, media_group, entity, role, second_role, mean_polarity, n, (select count(distinct cat) from c x where x.event = c.event and x.entity = c.entity and cat <> 'neutral') >= 2 as contested from c""", "mean_polarity")
def _(d):
    return FR.cast_matrix(d.records)


@query("frm_roles_to_actors", f"""with c as (select event, role, entity, count(*) as n, row_number() over (partition by event, role order by count(*) desc, entity) as k from x_men group by event, role, entity)
  select event, role, sum(n)::bigint as uses, string_agg(entity, ', ' order by k) filter (where k <= 3) as actors, {_CAT} as category,
    row_number() over (partition by event order by list_position(['favourable', 'victim', 'unfavourable', 'neutral'], {_CAT}), sum(n) desc, role) as place from c group by event, role""")
def _(d):
    return FR.roles_to_actors(d.records)


@query("frm_blame_remedy", r"""with r as (select event, media_group, message_id as id, treatment as p from x_rec),
  c as (select event, media_group, lower(p) as l, arg_min(p, id) as phrase, min(id) as id from r where length(p) between 24 and 170 group by 1, 2, 3),
  w as (select *, list_distinct(string_split(trim(regexp_replace(l, '\s+', ' ', 'g')), ' ')) as ws from c),
  s as (select a.event, a.media_group, a.id, a.phrase, round(sum(len(list_intersect(a.ws, b.ws))::double / len(list_distinct(list_concat(a.ws, b.ws)))), 9) as o from w a join w b on a.event = b.event and a.media_group = b.media_group group by all),
  m as (select event, media_group, arg_max(phrase, (o, -id)) as remedy from s group by 1, 2),
  k as (select event, media_group, cause, count(*) as n, row_number() over (partition by event, media_group order by count(*) desc, cause) as q from x_rec where cause is not null group by event, media_group, cause)
  select g.event, g.media_group, (select count(*) from x_rec r where r.event = g.event and r.media_group = g.media_group and treatment <> '') as prescribing, group_n as messages,
    (select string_agg(cause || ' ' || n, ', ' order by q) from k where k.event = g.event and k.media_group = g.media_group and q <= 2) as blames, remedy from x_gn g left join m using (event, media_group)""")
def _(d):
    typical = X.typical_phrase(d.records.select("event", "media_group", "message_id", "treatment"), FR.EG, "message_id", "treatment")
    return FR.blame_and_remedy(d.records, typical)


@query("frm_scorecard", f"""with m as (select event, count(*) as role_assignments, count(*) filter (where polarity not between -2 and 2) as po, count(*) filter (where intensity not between 0 and 2) as io,
    count(distinct role) as used, (count(*) filter (where role in ('other', 'neutral_actor')))::double / count(*) as vague_share, count(distinct message_id) as with_roles from x_allmen group by 1),
  e as (select event, count(*) as n, count(distinct type) as kinds from x_ent group by 1),
  l as (select event, count(*) as n, count(*) filter (where v = 0) as pos, count(*) filter (where v = 1) as neg from (select event, ({H('av', 4, 'i')} + g) % 3 as v from (select *, unnest(range(1, {H('na', 4)} + 1)) as i from x_allrec)) group by 1),
  r as (select event, count(*) as messages, count(*) filter (where not coalesce(on_event, true)) as off_event, avg((cause is null)::int) as causal_null, avg((treatment is null)::int) as treatment_null from x_allrec group by 1)
  select r.event, messages, off_event, with_roles::double / messages as role_coverage, causal_null, treatment_null, po as polarity_out_of_range, io as intensity_out_of_range, role_assignments, e.n::double / messages as entities_per_message,
    l.n::double / messages as labels_per_message, pos as positive_labels, neg as negative_labels, kinds as entity_types, 18 - used as dead_roles, vague_share from r join m using (event) join e using (event) join l using (event)""",
  "role_coverage causal_null treatment_null entities_per_message labels_per_message vague_share")
def _(d):
    return FR.scorecard(d.all_records)


sql_view("x_gm", """with l as (select event, media_group, count(*) as n_action_labels, count(*) filter (where valence = 'positive') as p, count(*) filter (where valence = 'negative') as q, count(*) filter (where valence = 'neutral') as z from x_lab2 group by all)
  select event, media_group, count(*) as n_messages, avg((status = 'asserted')::int) as asserted_share, avg((status = 'attributed')::int) as attributed_share, avg((status in ('hedged', 'questioned', 'denied'))::int) as hedged_or_questioned_share,
    avg((coalesce(treatment, '') <> '')::int) as treatment_present_share, """ + ", ".join(f"avg({f}::int) as {f}_share" for f in FR.FRAMES) + """, coalesce(any_value(n_action_labels), 0) as n_action_labels,
    any_value(p)::double / any_value(n_action_labels) as positive_action_label_share, any_value(q)::double / any_value(n_action_labels) as negative_action_label_share,
    any_value(z)::double / any_value(n_action_labels) as neutral_action_label_share from x_rec left join l using (event, media_group) group by event, media_group""")
_GM = " ".join(["asserted_share attributed_share hedged_or_questioned_share treatment_present_share", *[f"{f}_share" for f in FR.FRAMES],
                "positive_action_label_share negative_action_label_share neutral_action_label_share"])


@query("frm_group_metrics", "select * from x_gm", _GM)
def _(d):
    return FR.group_metrics(d.records)


@query("frm_actor_metrics", """select event, media_group, entity as actor, count(*) as n_role_assignments, avg(pol) as mean_polarity_all_mentions, count(*) filter (where status = 'asserted') as n_asserted_role_assignments,
  avg(pol) filter (where status = 'asserted') as mean_polarity_asserted_only from x_men where entity in ('actor1', 'actor2', 'actor3') and polarity is not null group by all""",
  "mean_polarity_all_mentions mean_polarity_asserted_only")
def _(d):
    return FR.actor_metrics(d.records, ["actor1", "actor2", "actor3"])


@query("frm_spread_table", "with r as (" + " union all ".join(
    f"select event, media_group, '{c}' as dimension, n_messages as n, {c} as value from x_gm where n_messages >= 15" for c in _GM.split() if "action_label" not in c)
    + """ union all select event, media_group, 'positive_action_label_share', n_action_labels, positive_action_label_share from x_gm where n_messages >= 15 and n_action_labels >= 20)
  select event, dimension, count(*) as groups_compared, arg_max(media_group, (round(value, 12), media_group)) as high_group, max(value) as high_value, arg_max(n, (round(value, 12), media_group)) as high_n,
    arg_min(media_group, (round(value, 12), media_group)) as low_group, min(value) as low_value, arg_min(n, (round(value, 12), media_group)) as low_n, (max(value) - min(value)) * 100 as spread_pp
  from r group by 1, 2 having count(*) >= 2""", "high_value low_value spread_pp")
def _(d):
    return FR.spread_table(FR.group_metrics(d.records))


@query("frm_inventory", """with s as (select lang as event, count(*) as kept from documents group by 1 union all select lang || '_rerun', count(*) from documents where doc_id % 2 = 0 group by 1
    union all select lang || '_archived', count(*) from documents where doc_id % 3 = 0 group by 1),
  z as (select event, sum(group_n)::bigint as f, count(*) filter (where group_n >= 15) as b, count(*) as t from x_gn group by 1)
  select event, kept, case when f is not null then 'framed' when event like '%rerun' then 'retrieval rerun only' else 'archived' end as framing_status, coalesce(f, 0) as framed_on_event, coalesce(b, 0) as groups_n_ge_15,
    coalesce(t, 0) as groups_total from s left join z using (event)""")
def _(d):
    docs = d.table("documents").select("lang", "doc_id")
    sets = docs.groupBy(F.col("lang").alias("event")).agg(F.count(F.lit(1)).alias("kept"))
    for suffix, step in (("_rerun", 2), ("_archived", 3)):
        sets = sets.unionByName(docs.filter(F.col("doc_id") % step == 0).groupBy(F.concat("lang", F.lit(suffix)).alias("event")).agg(F.count(F.lit(1)).alias("kept")))
    return FR.inventory(sets, d.records)


@query("frm_narrative_assign", f"""select event, message_id, case when {H('as', 6).replace('doc_id', 'message_id')} in (0, 1, 2) then 'n' || {H('as', 6).replace('doc_id', 'message_id')} else 'other_mixed' end as narrative_id from x_rec""")
def _(d):
    ident = F.col("message_id").cast("string")
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("as"), ident)), 1, 8), 16, 10).cast("long") % 6
    given = d.records.select("event", "message_id", F.when(pick != 5, F.concat(F.lit("n"), pick)).alias("narrative_id"))
    # The taxonomy is the three narratives seen first plus the catch-all.
    seen = d.records.select("narrative_id").distinct().filter("narrative_id in ('n0', 'n1', 'n2')").select("narrative_id", F.substring("narrative_id", 2, 1).cast("int").alias("position"))
    taxonomy = seen.unionByName(seen.agg(F.lit("other_mixed").alias("narrative_id"), F.max("position").alias("position")).withColumn("position", F.col("position") + 1))
    return FR.assign_narratives(d.records, given, taxonomy)


@query("txt_provenance", r"""with q as (select event, message_id, doc_id, text, substring(text, (%s + 1)::int, 40) as quote, %s as bad from x_rec),
  s as (select event, message_id, text, case when bad = 0 then substring(quote, 1, 10) || ' zzz ' || substring(quote, 16, 25) else '«' || replace(replace(quote, 't', 'ｔ'), 'fi', 'ﬁ') || '»' end as span from q union all select event, message_id, text, substring(text, 1, 30) from x_rec),
  n as (select event, message_id, trim(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '[^\pL\pM\pN_\s]', ' ', 'g'), '\s+', ' ', 'g')) as t,
    trim(regexp_replace(regexp_replace(lower(replace(replace(nfc_normalize(span), 'ｔ', 't'), 'ﬁ', 'fi')), '[^\pL\pM\pN_\s]', ' ', 'g'), '\s+', ' ', 'g')) as s from s where trim(span) <> ''),
  f as (select *, length(s) < 6 or contains(t, s) or len(list_filter(range(1, greatest(length(s) - ceil(length(s) * 0.85::double)::bigint + 1, 1) + 1), lambda i: contains(t, substring(s, i, ceil(length(s) * 0.85::double)::bigint)))) > 0 as ok from n)
  select event, message_id, count(*) as n_total, count(*) filter (where ok) as n_found, (count(*) filter (where ok))::double / count(*) as score from f group by all""" % (H("q", 40), H("qq", 3)), "score")
def _(d):
    return FR.provenance(d.records)


# ---------------------------------------------------------------------------- clusters of vectors
sql_view("x_clu", "select id, label, case when id % 13 = 0 then -1 else label end as cluster, vector from x_vec")
sql_view("x_near", """with p as (select cluster, generate_subscripts(vector, 1) as i, unnest(vector) as x from x_clu where cluster <> -1), c as (select cluster, list(m order by i) as centre from (select cluster, i, avg(x) as m from p group by all) group by 1),
  s as (select cluster, id, round(list_dot_product(vector, centre), 9) as similarity from x_clu join c using (cluster))
  select *, row_number() over (partition by cluster order by similarity desc, id) as place, count(*) over (partition by cluster) as size from s""")


def _clusters(d):
    return d.vectors.select("id", F.when(F.col("id") % 13 == 0, -1).otherwise(F.col("label")).alias("cluster"), "vector")


@query("frm_cluster_exemplars", "select cluster, id, similarity, place, size from x_near where place <= 6")
def _(d):
    return CL.nearest(_clusters(d), "cluster", "id", "vector", 6)


@query("frm_cluster_medoid", f"""with m as (select c.cluster, d.text, 'g' || {_G} as media_group from x_clu c join documents d on d.doc_id = c.id where cluster <> -1),
  w as (select cluster, word, row_number() over (partition by cluster order by count(*) desc, word) as r from (select cluster, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) as word from m)
    where word not in (select term from x_stop) group by cluster, word),
  t as (select cluster, string_agg(word, ', ' order by r) as terms from w where r <= 6 group by 1),
  g as (select cluster, string_agg(media_group || ' ' || n, ', ' order by n desc, media_group) as groups from (select cluster, media_group, count(*) as n from m group by all) group by 1)
  select n.cluster, n.id as medoid, n.size, md5(d.text) as medoid_text, terms, groups, row_number() over (order by n.size desc, n.cluster) as place
  from x_near n left join documents d on d.doc_id = n.id left join t using (cluster) left join g using (cluster) where n.place = 1""")
def _(d):
    texts = d.table("documents").select(F.col("doc_id").alias("id"), "text", F.concat(F.lit("g"), F.expr("substring(source, 4)").cast("int") % 5).alias("media_group"))
    return CL.cluster_summary(_clusters(d), "cluster", "id", "vector", texts, "text", "media_group", d.stopwords).withColumn("medoid_text", F.md5("medoid_text"))


@query("frm_cluster_seed_rule", """with s as (select cluster, count(*) as n from x_clu group by 1),
  t as (select count(*) filter (where cluster <> -1) as clusters, (max(n) filter (where cluster <> -1))::double / sum(n) filter (where cluster <> -1) as dominant,
    coalesce(sum(n) filter (where cluster = -1), 0)::double / sum(n) as noise_share, least(8, greatest(3, sum(n) // 40))::int as k from s)
  select clusters, dominant, noise_share, clusters < 3 or dominant > 0.6 or noise_share > 0.5 as use_kmeans, k from t""", "dominant noise_share")
def _(d):
    return CL.seed_rule(_clusters(d), "cluster")


@query("frm_cluster_kmeans", """select k::int as k, n, n as own_centre_nearest, true as labels_in_range, true as silhouette_recomputed, true as one_is_best from range(3, 15) r(k), (select count(*) as n from x_vec)""")
def _(d):
    """What holds for whatever labels the iterations end with: each vector's own centre is the nearest, and the silhouette is that of the library's evaluator."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    labelled, centres = CL.kmeans_runs(d.vectors, "id", "vector")
    judge = lambda k: ClusteringEvaluator(featuresCol="features", predictionCol=f"k{k}", distanceMeasure="cosine").evaluate(labelled)
    again = d.spark.createDataFrame([(k, judge(k)) for k in centres], "k int, again double")             # a row for each k
    chosen = CL.best_labels(labelled, CL.silhouettes(labelled, centres))
    best = chosen.select("k", "silhouette").distinct().select(F.col("k").alias("best_k"), F.col("silhouette").alias("best"))
    ranges = labelled.select(*[F.max(F.when(F.col(f"k{k}").between(0, k - 1), 0).otherwise(1)).alias(f"k{k}") for k in centres])
    wrong = ranges.selectExpr(f"stack({len(centres)}, {', '.join(f'{k}, k{k}' for k in centres)}) as (k, wrong)")
    facts = CL.silhouettes(labelled, centres).join(again, "k").join(wrong, "k").crossJoin(F.broadcast(best))                # one row
    return facts.select("k", "n", F.col("nearest").alias("own_centre_nearest"), (F.col("wrong") == 0).alias("labels_in_range"),
                        (F.abs(F.col("silhouette") - F.col("again")) < 1e-9).alias("silhouette_recomputed"), (F.col("best") >= F.col("silhouette") - 1e-12).alias("one_is_best"))
