"""Vector search and relevance-evaluation queries with their checking SQL."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsgauge.functions.text import uniform
from newsgauge.operators import relevance as RL
from newsgauge.operators import retrieval as RT
from newsgauge.operators.scaling import rank_by_score, running_sum
from newsgauge.plans.catalog import query, sql_view

E = ["event"]


def U(salt: str, ident: str = "doc_id") -> str:
    return f"(('0x' || substr(md5('{salt}|' || {ident}), 1, 8))::bigint / 4294967296::double)"


def _flip(salt: str, share: float) -> str:
    return f"case when {U(salt)} < {share} then quality <> 1 else quality = 1 end"


sql_view("x_r", f"""with b as (select lang as event, d.doc_id as post_id, d.doc_id, length(text)::int as chars, {U('cos', 'd.doc_id')} * 0.6::double + coalesce(quality, 0) * 0.3::double as cos,
    {U('a', 'd.doc_id')} * 0.7::double + coalesce(quality, 0) * (1 - 0.7::double) as score_a, {U('b', 'd.doc_id')} * 0.8::double + coalesce(quality, 0) * (1 - 0.8::double) as score_b,
    {U('c', 'd.doc_id')} as score_c, quality from documents d left join labels l on l.doc_id = d.doc_id),
  k as (select *, row_number() over (partition by event order by cos desc, post_id) as rank, quality = 1 as truth, {_flip('j2', 0.1)} as judge2, {_flip('j3', 0.15)} as judge3,
    case when {U('rd')} >= 0.05 then {_flip('r1', 0.08)} end as reader, {_flip('r2', 0.2)} as reader2 from b),
  j as (select * replace (case when quality is null then null else judge2 end as judge2, case when quality is null then null else judge3 end as judge3,
      case when quality is null then null else reader end as reader, case when quality is null then null else reader2 end as reader2),
    case when rank <= 150 then 0 when rank <= 500 then 1 when rank <= 1000 then 2 when rank <= 2000 then 3 when rank <= 3000 then 4 else 5 end as band from k)
  select event, post_id, chars, cos, score_a, score_b, score_c, truth, judge2, judge3, reader, reader2, rank, band,
    case when truth is not null then (count(*) over (partition by event, band))::double / count(truth) over (partition by event, band) end as weight from j""")
sql_view("x_lab", "select * from x_r where truth is not null")
sql_view("x_curve", f"""with c as (select distinct event, round(score_a, 4) as cut from x_lab)
  select c.event, cut, coalesce(sum(weight) filter (where truth and score_a >= cut), 0) as tp, coalesce(sum(weight) filter (where not truth and score_a >= cut), 0) as fp,
    coalesce(sum(weight) filter (where truth), 0) as on_event from c join x_lab using (event) group by all""")


def _curve(name: str, score: str, label: str = "truth") -> None:
    sql_view(name, f"""with c as (select distinct event, round({score}, 4) as cut from x_lab)
      select c.event, cut, coalesce(sum(weight) filter (where {label} and {score} >= cut), 0) as tp, coalesce(sum(weight) filter (where not {label} and {score} >= cut), 0) as fp,
        coalesce(sum(weight) filter (where {label}), 0) as on_event from c join x_lab using (event) group by all""")


_F1 = "coalesce(2 * tp / nullif(on_event + tp + fp, 0), 0)"
_curve("x_curveb", "score_b")
_curve("x_curver", "score_a", "coalesce(reader, truth)")
_curve("x_curver2", "score_a", "coalesce(reader2, truth)")
for _v, _c in (("x_best", "x_curve"), ("x_bestb", "x_curveb"), ("x_bestr", "x_curver"), ("x_bestr2", "x_curver2")):
    sql_view(_v, f"select event, arg_max(cut, (round({_F1}, 12), -cut)) as cut from {_c} group by 1")


def conf(kept: str, source: str = "x_lab", keys: str = "event", truth: str = "truth", weight: str = "weight") -> str:
    return f"""select {keys}, coalesce(sum({weight}) filter (where {truth} and {kept}), 0)::double as tp, coalesce(sum({weight}) filter (where not {truth} and {kept}), 0)::double as fp,
      coalesce(sum({weight}) filter (where {truth}), 0)::double as on_event from {source} group by {keys}"""


_CONF = f"select event, tp, fp, on_event - tp as lost, fp as extra, tp + fp as kept, on_event, {_F1} as f1"


# ---------------------------------------------------------------------------- vectors
sql_view("x_vec", """select vec_id as id, vec_id // 4 as owner_id, (vec_id // 4 % 3)::int as win, label,
  list_transform(embedding::double[], lambda x: x / greatest(sqrt(list_dot_product(embedding::double[], embedding::double[])), 1e-12)) as vector from embeddings""")
sql_view("x_probe", """select label as event_id, label % 3 as win, rn - 1 as probe, vector as q from (select *, row_number() over (partition by label order by id) as rn from x_vec) where rn <= 3""")
sql_view("x_ps", """select event_id, v.id, max(round(list_dot_product(vector, q), 12)) as score, arg_max(probe, (round(list_dot_product(vector, q), 12), -probe))::int as probe
  from x_vec v join x_probe p on p.win = v.win group by all""")


@query("vec_l2_normalise", "select id, vector[1] as first_part, vector[64] as last_part, sqrt(list_dot_product(vector, vector)) as norm from x_vec", "first_part last_part norm")
def _(d):
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return d.vectors.select("id", F.element_at("vector", 1).alias("first_part"), F.element_at("vector", 64).alias("last_part"), norm.alias("norm"))


@query("vec_max_probe", "select event_id, id, score, probe from x_ps", "score")
def _(d):
    return d.probe_scores


@query("vec_multi_event", "select event_id, count(*) as scored, avg(score) as mean_best, max(score) as best from x_ps group by 1", "mean_best best")
def _(d):
    return RT.probe_summary(d.vectors, d.probes, "window", "id", "vector")


_POOL = """select e.event_id, o.owner_id, coalesce(max(s.score), -1) as score from (select distinct event_id, win from x_probe) e
  join (select distinct owner_id, win from x_vec) o using (win) left join (select s.*, v.owner_id from x_ps s join x_vec v using (id) where v.owner_id % 17 <> 0) s
  on s.event_id = e.event_id and s.owner_id = o.owner_id group by all"""
sql_view("x_pool", _POOL)


def _fragment_scores(d, **limits):
    """A post's fragments are vectors of one id; every seventeenth post has none."""
    return RT.probe_scores(d.vectors.filter("owner_id % 17 <> 0"), d.probes, "window", "owner_id", "vector", **limits)


@query("vec_fragment_pool", "select * from x_pool", "score")
def _(d):
    owners = d.vectors.select("owner_id", "window").distinct().join(d.probes.select("event_id", "window").distinct(), "window").select("event_id", "owner_id")
    return RT.pool_fragments(_fragment_scores(d), owners)


@query("vec_top_k", "select * from (select event_id, owner_id, score, row_number() over (partition by event_id order by score desc, owner_id) as rank from x_pool where score >= 0.1) where rank <= 25", "score")
def _(d):
    scores = _fragment_scores(d, top_k=25, floor=0.1).select("event_id", F.col("id").alias("owner_id"), "score")
    return RT.candidates(scores, ["event_id"], "score", "owner_id", top_k=25, floor=0.1)


@query("vec_space_check", """with v as (select id, 'rounded' as variant, list_transform(vector, lambda x: round(x, 1)) as b from x_vec union all
    select a.id, 'neighbour', n.vector from x_vec a join x_vec n on n.id = xor(a.id, 1)),
  m as (select variant, avg(list_dot_product(x.vector, b)) as mean_cosine from v join x_vec x using (id) group by 1)
  select *, row_number() over (order by mean_cosine desc) = 1 as is_best from m""", "mean_cosine")
def _(d):
    rounded = d.vectors.select("id", F.lit("rounded").alias("variant"), F.transform("vector", lambda x: F.round(x, 1)).alias("vector"))
    neighbour = d.vectors.select(F.col("id").bitwiseXOR(F.lit(1)).alias("id"), F.lit("neighbour").alias("variant"), "vector")
    return RT.space_check(d.vectors, rounded.unionByName(neighbour), "id")


@query("vec_rerank_pool", f"""with s as (select lang, doc_id, p as probe, round({U('p', "doc_id || '|' || p")}, 1) as score from documents, range(4) r(p))
  select lang, doc_id, max(score) as rerank_score, arg_max(probe, (score, -probe)) as rerank_probe from s group by all""", "rerank_score")
def _(d):
    scores = d.table("documents").select("lang", "doc_id", F.explode(F.expr("sequence(0L, 3L)")).alias("probe")).withColumn(
        "score", F.round(uniform("p", F.col("doc_id"), F.col("probe")), 1))
    return RT.rerank_pool(scores, ["lang", "doc_id"])


@query("prj_window_scan", """with p as (select vec_id, case when vec_id % 19 = 0 then 'undated' else strftime(date '2025-01-01' + (vec_id % 60)::int, '%Y-%m-%d') || 'T08:00:00' end as date,
    case when vec_id % 23 = 0 then [] else embedding end as v from embeddings)
  select vec_id, try_cast(date as timestamp)::date as day from p where try_cast(date as timestamp) >= '2025-01-10' and try_cast(date as timestamp) < '2025-02-01' and len(v) > 0""")
def _(d):
    day = F.date_add(F.lit("2025-01-01").cast("date"), (F.col("vec_id") % 60).cast("int"))
    date = F.when(F.col("vec_id") % 19 == 0, "undated").otherwise(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T08:00:00")))
    vector = F.when(F.col("vec_id") % 23 != 0, F.col("embedding")).otherwise(F.array().cast("array<float>"))
    posts = d.table("embeddings").select("vec_id", date.alias("date"), vector.alias("v"))
    return RT.window_scan(posts, "2025-01-10", "2025-02-01", "date", "v").select("vec_id", F.to_date("at").alias("day"))


# ---------------------------------------------------------------------------- candidate lists and sets
@query("top_k_candidates", "select * from (select event, post_id, cos, row_number() over (partition by event order by cos desc, post_id) as rank from x_r where cos >= 0.2) where rank <= 3000", "cos")
def _(d):
    return RT.candidates(d.candidates.select("event", "post_id", "cos"), E, "cos", "post_id", top_k=3000, floor=0.2, lo=0.0)


@query("join_nearest_in_order", "select event, rank, doc_id, source, md5(text) as digest from x_r join documents on doc_id = post_id where rank <= 300")
def _(d):
    top = d.candidates.filter("rank <= 300").select("event", "rank", F.col("post_id").alias("doc_id"))
    return d.table("documents").join(top, "doc_id").select("event", "rank", "doc_id", "source", F.md5("text").alias("digest"))


@query("top_k_review_sample", """with k as (select event, post_id, score_a, row_number() over (partition by event order by score_a desc, post_id) as rank from x_r),
  n as (select *, row_number() over (partition by event order by rank) as near from k where score_a >= 0.5 - 0.1::double and score_a < 0.5 + 0.1::double)
  select event, post_id, score_a, rank from k where rank <= 50 union select event, post_id, score_a, rank from n where near <= 30""", "score_a")
def _(d):
    ranked = rank_by_score(d.candidates.select("event", "post_id", "score_a"), E, "score_a", "post_id", 0.0, 1.0)
    return RT.review_sample(ranked, E, "rank", "score_a", 0.5)


_OLD, _NEW = "score_a >= 0.6", "score_b >= 0.6"


def _kept(d, column):
    return d.candidates.filter(F.col(column) >= 0.6).select("event", "post_id", F.col(column).alias("score"))


@query("set_added_dropped", f"""select event, post_id, 'added' as direction, score_b as score, null::double as new_score from x_r where {_NEW} and not {_OLD}
  union all select event, post_id, 'dropped', score_a, case when score_b >= 0.1 then score_b end from x_r where {_OLD} and not {_NEW}""", "score new_score")
def _(d):
    cands = d.candidates.filter("score_b >= 0.1").select("event", "post_id", F.col("score_b").alias("score"))
    return RT.added_dropped(_kept(d, "score_a"), _kept(d, "score_b"), cands, ["event", "post_id"])


@query("smp_fixed_random", f"select event, post_id, score_a from x_r where ({_OLD}) <> ({_NEW}) order by md5('17|' || event || '|' || post_id) limit 50", "score_a")
def _(d):
    changed = d.candidates.filter((F.col("score_a") >= 0.6) != (F.col("score_b") >= 0.6)).select("event", "post_id", "score_a")
    return changed.orderBy(F.md5(F.concat_ws("|", F.lit("17"), "event", "post_id"))).limit(50)


sql_view("x_two", """select event, post_id, truth, row_number() over (partition by event order by cos desc, post_id) as r1, row_number() over (partition by event order by score_a desc, post_id) as r2 from x_r""")


def _two(d):
    base = d.candidates.select("event", "post_id", "truth", F.col("rank").alias("r1"), "score_a")
    return rank_by_score(base, E, "score_a", "post_id", 0.0, 1.0, out="r2")


@query("set_symmetric_topk", """select event, post_id, case when r1 <= 100 and r2 <= 100 then 'both' when r1 <= 100 then 'only first' else 'only second' end as side from x_two where r1 <= 100 or r2 <= 100""")
def _(d):
    two = _two(d)
    keys = ["event", "post_id"]
    a, b = two.filter("r1 <= 100").select(*keys), two.filter("r2 <= 100").select(*keys)
    sides = ((a.intersect(b), "both"), (a.subtract(b), "only first"), (b.subtract(a), "only second"))
    parts = [frame.withColumn("side", F.lit(name)) for frame, name in sides]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("set_union_pool", "select event, post_id from x_two where r1 <= 120 or r2 <= 120")
def _(d):
    two = _two(d)
    return two.filter("r1 <= 120").select("event", "post_id").union(two.filter("r2 <= 120").select("event", "post_id")).distinct()


@query("win_cumulative", "select event, post_id, rank, sum(coalesce(truth, false)::int) over (partition by event order by rank)::bigint as hits from x_r")
def _(d):
    hit = d.candidates.withColumn("hit", F.coalesce("truth", F.lit(False)).cast("int"))
    return running_sum(hit, "rank", "hit", "hits", E).select("event", "post_id", "rank", "hits")


@query("agg_histogram", "select event, least(floor(least(greatest(score_a, 0), 1) * 10), 9)::bigint as bin, count(*) as n from x_r group by all")
def _(d):
    clipped = F.least(F.greatest(F.col("score_a"), F.lit(0.0)), F.lit(1.0))
    return d.candidates.groupBy("event", F.least(F.floor(clipped * 10), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------- cuts and curves
@query("rel_threshold", """select event_id, count(*) as candidates, count(*) filter (where keyword_match) as keyword_candidates, count(*) filter (where k) as kept,
  count(distinct case when k then source_name end) as sources, count(*) filter (where k and keyword_match) as kept_keyword, count(*) filter (where k and not keyword_match) as kept_semantic_only,
  (count(*) filter (where k and keyword_match))::double / nullif(count(*) filter (where keyword_match), 0) as keyword_retention
  from (select *, rerank_score >= 0.95::double as k from x_rawmatches) group by 1""", "keyword_retention")
def _(d):
    k, kw = F.col("rerank_score") >= 0.95, F.col("keyword_match")
    by_source = d.raw_matches.groupBy("event_id", "source_name").agg(
        F.count(F.lit(1)).alias("c"), F.count_if(kw).alias("kc"), F.count_if(k).alias("k"), F.count_if(k & kw).alias("kk"))
    return by_source.groupBy("event_id").agg(
        F.sum("c").alias("candidates"), F.sum("kc").alias("keyword_candidates"), F.sum("k").alias("kept"), F.count_if(F.col("k") > 0).alias("sources"),
        F.sum("kk").alias("kept_keyword"), (F.sum("k") - F.sum("kk")).alias("kept_semantic_only"),
        (F.sum("kk").cast("double") / F.nullif(F.sum("kc"), F.lit(0))).alias("keyword_retention"))


@query("rel_rethreshold", """select event_id, source_name, message_id, rerank_score, keyword_match from x_rawmatches where rerank_score >= 0.97::double
  and source_name not in (select source_name from x_archived)""", "rerank_score")
def _(d):
    saved = d.raw_matches.withColumn("flag", F.when(F.col("keyword_match"), "True").otherwise("false"))
    return saved.filter(F.col("rerank_score") >= 0.97).join(d.archived, "source_name", "left_anti").select(
        "event_id", "source_name", "message_id", "rerank_score", F.trim("flag").try_cast("boolean").alias("keyword_match"))


@query("rel_confusion", f"{_CONF} from ({conf('score_a >= 0.5')})", "tp fp lost extra kept on_event f1")
def _(d):
    return RL.confusion(d.labelled, E, F.col("score_a") >= 0.5, "truth", "weight")


@query("rel_best_cut", f"select event, cut, {_F1} as f1, tp, fp, on_event, on_event - tp as lost from x_curve join x_best using (event, cut)", "f1 tp fp on_event lost")
def _(d):
    return RL.best_cut(d.labelled, E, "score_a", "truth", "weight")


sql_view("x_auc", """select e.event, auc from (select distinct event from x_lab) e left join (select a.event, sum(a.weight * b.weight * case when a.score_a > b.score_a then 1 when a.score_a = b.score_a then 0.5 else 0 end)::double
  / sum(a.weight * b.weight) as auc from x_lab a join x_lab b on a.event = b.event where a.truth and not b.truth group by 1) p using (event)""")
sql_view("x_aucb", """select e.event, auc from (select distinct event from x_lab) e left join (select a.event, sum(a.weight * b.weight * case when a.score_b > b.score_b then 1 when a.score_b = b.score_b then 0.5 else 0 end)::double
  / sum(a.weight * b.weight) as auc from x_lab a join x_lab b on a.event = b.event where a.truth and not b.truth group by 1) p using (event)""")


@query("rel_auc_weighted", "select event, auc from x_auc", "auc")
def _(d):
    return RL.weighted_auc(d.labelled, E, "score_a", "truth", "weight")


@query("rel_auc_rank", """with k as (select event, truth, row_number() over (partition by event order by score_a, post_id) as r from x_lab)
  select event, (sum(r) filter (where truth) - count(*) filter (where truth) * (count(*) filter (where truth) + 1) / 2)::double
    / nullif(count(*) filter (where truth) * count(*) filter (where not truth), 0) as auc from k group by 1""", "auc")
def _(d):
    ranked = rank_by_score(d.labelled, E, "score_a", "post_id", 0.0, 1.0, out="r", descending=False)
    return RL.rank_auc(ranked, E, "r", "truth")


@query("rel_recall_at_k", """select event, k::int as k, (count(*) filter (where truth and rank <= k))::double / greatest(count(*) filter (where truth), 1) as recall
  from x_r, (values (50), (100), (200), (300), (500)) v(k) group by all""", "recall")
def _(d):
    return RL.recall_at(d.candidates, E, "rank", F.coalesce("truth", F.lit(False)), [50, 100, 200, 300, 500])


@query("rel_precision_recall_pool", """with p as (select event, coalesce(truth, false) as rel, r1, r2 from x_two where r1 <= 120 or r2 <= 120),
  m as (select event, rel, unnest(['cosine', 'scorer']) as method, unnest([r1, r2]) as r from p),
  h as (select event, method, k::int as k, count(*) filter (where rel and r <= k) as hits, count(*) filter (where rel) as n from m, (values (20), (50), (100), (120)) v(k) group by all)
  select event, method, k, hits, round(hits::double / k, 3) as precision, round(hits::double / greatest(n, 1), 3) as recall_of_pool from h""")
def _(d):
    pool = _two(d).filter("r1 <= 120 or r2 <= 120").withColumn("rel", F.coalesce("truth", F.lit(False)))
    return RL.precision_recall_pool(pool, E, {"cosine": "r1", "scorer": "r2"}, "rel", [20, 50, 100, 120])


@query("rel_threshold_sweep", """with m as (select event, truth, unnest(['a', 'b']) as scorer, unnest([score_a, score_b]) as s from x_lab),
  t as (select *, unnest([0.1, 0.2, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7]::double[]) as threshold from m)
  select event, scorer, threshold, count(*) filter (where s >= threshold) as kept, count(*) filter (where truth and s >= threshold) as on_event_kept,
    count(*) filter (where truth and s < threshold) as on_event_lost, count(*) filter (where not truth and s >= threshold) as off_event_kept from t group by all""")
def _(d):
    return RL.threshold_sweep(d.labelled, E, {"a": "score_a", "b": "score_b"}, "truth", [0.1, 0.2, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7])


# ---------------------------------------------------------------------------- samples
_BAND = "least(floor((score_a - min(score_a) over (partition by event)) / (max(score_a) over (partition by event) - min(score_a) over (partition by event)) * 10), 9)::int"
sql_view("x_bandsample", f"""with b as (select event, post_id, score_a, {_BAND} as wband from x_r),
  k as (select *, count(*) over (partition by event, wband) as size, row_number() over (partition by event, wband order by md5('17|' || post_id)) as rn from b)
  select event, post_id, wband as band, size::double / least(size, 10) as weight from k where rn <= 10""")


@query("rel_band_sample", "select * from x_bandsample", "weight")
def _(d):
    banded = RL.width_bands(d.candidates.select("event", "post_id", "score_a"), E, "score_a")
    return RL.take_per_band(banded, E, "band", "post_id", 10, "17").select("event", "post_id", "band", "weight")


@query("rel_rank_band_sample", """with k as (select event, post_id, band, count(*) over (partition by event, band) as size, row_number() over (partition by event, band order by md5('18|' || post_id)) as rn
  from x_r where band < 5) select event, post_id, band, size::double / least(size, 150) as weight from k where rn <= 150""", "weight")
def _(d):
    banded = d.candidates.filter("band < 5").select("event", "post_id", "band")
    return RL.take_per_band(banded, E, "band", "post_id", 150, "18").select("event", "post_id", "band", "weight")


def _mixed(x: str, at: int, spread: int) -> str:
    """A digest's 32 bits shuffled by the seed; {x}5 is the last step."""
    low = "% 4294967296::ubigint"
    steps = f"xor(('0x' || substr(digest, {at}, 8))::ubigint, (seed::ubigint * {spread}::ubigint) {low}) as {x}0, xor({x}0, {x}0 >> 16) as {x}1, ({x}1 * {RL._MIX[0]}::ubigint) {low} as {x}2"
    return steps + f", xor({x}2, {x}2 >> 13) as {x}3, ({x}3 * {RL._MIX[1]}::ubigint) {low} as {x}4, xor({x}4, {x}4 >> 16) as {x}5"


_SPREAD = RL._SPREAD


def sample_sql(prefix: str, score: str, label: str, source: str = "x_lab", per: int = 6) -> None:
    """Views of the 200-seed sample cut: {prefix} has (event, seed, cut)."""
    band = _BAND.replace("score_a", score)
    sql_view(f"{prefix}_picks", f"""with b as (select event, post_id, {score} as s, {label} as lab, weight, {band} as wband from {source}),
      m as (select *, count(*) over (partition by event, wband) as size, sum(weight) over (partition by event, wband) as mass from b),
      d as (select *, md5(event || '|' || post_id) as digest from m),
      h as (select *, {_mixed('h', 1, _SPREAD[0])}, {_mixed('l', 9, _SPREAD[1])} from d, range(1, 201) r(seed)),
      k as (select *, row_number() over (partition by event, wband, seed order by -ln(((h5 >> 5) * 67108864 + (l5 >> 6) + 1)::double / 9007199254740993::double) / weight, post_id) as rn from h)
      select event, seed, s, lab, mass / least(size, {per}) as w from k where rn <= {per}""")
    sql_view(prefix, f"""with c as (select distinct event, seed, round(s, 4) as cut from {prefix}_picks),
      f as (select c.event, c.seed, cut, coalesce(sum(w) filter (where lab and s >= cut), 0) as tp, coalesce(sum(w) filter (where not lab and s >= cut), 0) as fp,
        coalesce(sum(w) filter (where lab), 0) as on_event from c join {prefix}_picks p on p.event = c.event and p.seed = c.seed group by all)
      select event, seed, arg_max(cut, (round({_F1}, 12), -cut)) as cut from f group by 1, 2""")


sample_sql("x_sca", "score_a", "truth")
sample_sql("x_scb", "score_b", "truth")
sample_sql("x_scr", "score_a", "coalesce(reader, truth)")
_SUMMARY = f"avg({_F1}) as f1, quantile_cont({_F1}, 0.1) as f1_p10, avg(on_event - tp) as lost, avg(fp) as extra"


@query("rel_sample_cut", f"select event, {_SUMMARY} from x_sca join x_curve using (event, cut) group by 1", "f1 f1_p10 lost extra")
def _(d):
    return RL.sample_summary(RL.sample_cut(d.labelled, E, "post_id", "score_a", "truth", "weight"), E)


sql_view("x_loo", f"""with c as (select distinct h.event as held, round(o.score_a, 4) as cut from (select distinct event from x_lab) h join x_lab o on o.event <> h.event),
  g as (select held, cut, coalesce(sum(weight) filter (where truth and score_a >= cut), 0) as tp, coalesce(sum(weight) filter (where not truth and score_a >= cut), 0) as fp,
    sum(weight) filter (where truth) as on_event from c join x_lab on event <> held group by all)
  select held as event, arg_max(cut, (round({_F1}, 12), -cut)) as global_cut from g group by 1""")


@query("rel_global_cut_loo", f"""with q as ({conf('score_a >= global_cut', 'x_lab join x_loo using (event)', 'event, global_cut')})
  select event, global_cut, tp, fp, on_event - tp as lost, fp as extra, tp + fp as kept, on_event, {_F1} as f1 from q""", "tp fp lost extra kept on_event f1")
def _(d):
    return RL.leave_one_out_cut(d.labelled, "event", "score_a", "truth", "weight")


@query("rel_reader_cut", f"select event, cut, {_F1} as f1, on_event - tp as lost, fp as extra from x_bestr join x_curve using (event, cut)", "f1 lost extra")
def _(d):
    read = d.labelled.withColumn("lab", F.coalesce("reader", "truth"))
    cut = RL.best_cut(read, E, "score_a", "lab", "weight").select("event", "cut")
    return RL.cut_curve(d.labelled, E, "score_a", "truth", "weight").join(cut, ["event", "cut"]).select("event", "cut", "f1", "lost", F.col("fp").alias("extra"))


# ---------------------------------------------------------------------------- judges, votes and readers
@query("rel_agreement", """select event, avg((truth = judge2)::int) as agree_first_second, avg((truth = judge3)::int) as agree_first_third, avg((judge2 = judge3)::int) as agree_second_third,
  avg((truth = judge2 and judge2 = judge3)::int) as unanimous, count(*) filter (where truth) as first_on, count(*) filter (where judge2) as second_on, count(*) filter (where judge3) as third_on
  from x_lab group by 1""", "agree_first_second agree_first_third agree_second_third unanimous")
def _(d):
    def share(c):
        return F.avg(c.cast("int"))
    a, b, c = F.col("truth"), F.col("judge2"), F.col("judge3")
    return d.labelled.groupBy("event").agg(
        share(a == b).alias("agree_first_second"), share(a == c).alias("agree_first_third"), share(b == c).alias("agree_second_third"),
        share((a == b) & (b == c)).alias("unanimous"), F.count_if(a).alias("first_on"), F.count_if(b).alias("second_on"), F.count_if(c).alias("third_on"))


sql_view("x_maj", "select *, truth::int + judge2::int + judge3::int as votes, truth::int + judge2::int + judge3::int >= 2 as majority from x_lab")


@query("rel_majority_vote", "select event, post_id, votes, majority, case votes when 3 then 'unanimous yes' when 0 then 'unanimous no' else 'disagreement' end as vote_group from x_maj")
def _(d):
    m = RL.majority(d.labelled, ["truth", "judge2", "judge3"])
    group = F.when(F.col("votes") == 3, "unanimous yes").when(F.col("votes") == 0, "unanimous no").otherwise("disagreement")
    return m.select("event", "post_id", "votes", "majority", group.alias("vote_group"))


@query("rel_agreed_reweight", """select event, post_id, truth, weight * (count(*) over (partition by event, weight)) / (count(*) filter (where truth = judge2) over (partition by event, weight)) as agreed_weight
  from x_lab qualify truth = judge2""", "agreed_weight")
def _(d):
    return RL.agreed_only(d.labelled, E, "truth", "judge2", "weight").select("event", "post_id", "truth", "agreed_weight")


@query("rel_depth_bands", """select event, band, count(*) as scored, count(truth) as labelled, round(avg(truth::int), 3) as label_share, coalesce(sum(weight) filter (where truth), 0) as on_event_estimate,
  round(avg((score_a >= 0.5)::int), 3) as predicted_share from x_r group by all""", "on_event_estimate")
def _(d):
    return d.candidates.groupBy("event", "band").agg(
        F.count(F.lit(1)).alias("scored"), F.count("truth").alias("labelled"), F.round(F.avg(F.col("truth").cast("int")), 3).alias("label_share"),
        RL.weight_where(F.col("truth"), "weight").alias("on_event_estimate"), F.round(F.avg((F.col("score_a") >= 0.5).cast("int")), 3).alias("predicted_share"))


@query("rel_stop_rule", """with p as (select * from (values (20, 0.4::double), (50, 0.3::double), (50, 0.05::double)) v(batch, floor)),
  b as (select event, batch, floor, (rank - 1) // batch as b, avg((score_a >= 0.5)::int) as share, count(*) as n from x_r, p group by event, batch, floor, (rank - 1) // batch),
  f as (select event, batch, floor, least((coalesce(min(b) filter (where share < floor), max(b)) + 1) * batch, sum(n))::bigint as depth from b group by event, batch, floor)
  select f.event, batch, floor as stop_below, depth, coalesce(sum(weight) filter (where truth and rank <= depth), 0) / sum(weight) filter (where truth) as share_of_on_event
  from f join x_r r on r.event = f.event group by f.event, batch, floor, depth""", "share_of_on_event")
def _(d):
    out = None
    for batch, floor in ((20, 0.4), (50, 0.3), (50, 0.05)):
        depth = RL.stop_rule(d.candidates, E, "rank", "score_a", batch, floor)
        share = RL.weight_where(F.col("truth") & (F.col("rank") <= F.col("depth")), "weight") / RL.weight_where(F.col("truth"), "weight")
        part = d.candidates.join(depth, "event").groupBy("event", "depth").agg(share.alias("share_of_on_event")).select(
            "event", F.lit(batch).alias("batch"), F.lit(floor).alias("stop_below"), "depth", "share_of_on_event")
        out = part if out is None else out.unionByName(part)
    return out


_RULES = {"cos>=0.7": ("cos >= 0.7", 1.0), "top 30": ("rank <= 30", 1.0), "cos<0.2": ("cos < 0.2", 0.0), "rank>200": ("rank > 200", 0.0)}


def _rule_sql(name, rule, value):
    s = f"case when {rule} then {value} else score_a end"
    return f"""select a.event, '{name}' as rule, n, ref_yes, ref_no, f1_base, {_F1} as f1_rule, {_F1} - f1_base as f1_change from ({conf(f'{s} >= 0.5')}) a
      join (select event, count(*) filter (where {rule}) as n, coalesce(sum(weight) filter (where truth and {rule}), 0) as ref_yes, coalesce(sum(weight) filter (where not truth and {rule}), 0) as ref_no from x_r group by 1) g using (event)
      join (select event, {_F1} as f1_base from ({conf('score_a >= 0.5')})) b using (event)"""


@query("rel_auto_yes_no", " union all ".join(_rule_sql(k, *v) for k, v in _RULES.items()), "ref_yes ref_no f1_base f1_rule f1_change")
def _(d):
    base = RL.confusion(d.labelled, E, F.col("score_a") >= 0.5, "truth", "weight").select("event", F.col("f1").alias("f1_base"))
    out = None
    for name, (rule, value) in _RULES.items():
        hit = F.expr(rule)
        forced = RL.confusion(d.labelled, E, F.when(hit, value).otherwise(F.col("score_a")) >= 0.5, "truth", "weight").select("event", F.col("f1").alias("f1_rule"))
        size = d.candidates.groupBy("event").agg(F.count_if(hit).alias("n"), RL.weight_where(F.col("truth") & hit, "weight").alias("ref_yes"),
                                                 RL.weight_where(~F.col("truth") & hit, "weight").alias("ref_no"))
        part = size.join(forced, "event").join(base, "event").select(
            "event", F.lit(name).alias("rule"), "n", "ref_yes", "ref_no", "f1_base", "f1_rule", (F.col("f1_rule") - F.col("f1_base")).alias("f1_change"))
        out = part if out is None else out.unionByName(part)
    return out


@query("rel_flip_compare", """select event, count(*) filter (where (score_a >= 0.5) = truth and (score_b >= 0.5) <> truth) as good_to_bad,
  count(*) filter (where (score_a >= 0.5) <> truth and (score_b >= 0.5) = truth) as bad_to_good, avg(abs(score_a - score_b)) as mean_change from x_lab group by 1""", "mean_change")
def _(d):
    a, b = (F.col("score_a") >= 0.5) == F.col("truth"), (F.col("score_b") >= 0.5) == F.col("truth")
    return d.labelled.groupBy("event").agg(F.count_if(a & ~b).alias("good_to_bad"), F.count_if(~a & b).alias("bad_to_good"),
                                           F.avg(F.abs(F.col("score_a") - F.col("score_b"))).alias("mean_change"))


_RUNS = {"base_1": "score_a", "base_2": "(score_a * 0.9 + score_c * 0.1)", "new_1": "score_b", "new_2": "(score_b * 0.9 + score_c * 0.1)"}


def _run_sql(name, s):
    s = s.replace("0.9", "0.9::double").replace("0.1", "0.1::double")
    return f"""select event, '{name}' as run, count(*) filter (where truth <> ({s} >= 0.5)) as errors, coalesce(2 * count(*) filter (where truth and {s} >= 0.5)::double
      / nullif(count(*) filter (where truth) + count(*) filter (where {s} >= 0.5), 0), 0) as f1,
      (select sum(case when a.s > b.s then 1 when a.s = b.s then 0.5 else 0 end)::double / count(*) from (select {s} as s from x_lab p where p.event = x_lab.event and p.truth) a,
        (select {s} as s from x_lab q where q.event = x_lab.event and not q.truth) b) as auc from x_lab group by event"""


sql_view("x_runs", " union all ".join(_run_sql(k, v) for k, v in _RUNS.items()))


@query("rel_acceptance_gates", """with m as (select left(run, length(run) - 2) as variant, sum(errors) as errors, avg(f1) as f1, avg(auc) as auc from x_runs group by 1),
  p as (select b.* , n.errors as ne, n.f1 as nf, n.auc as na from (select * from m where variant = 'base') b, (select * from m where variant = 'new') n),
  e as (select event, avg(f1) filter (where run like 'base%') - avg(f1) filter (where run like 'new%') as drop, abs(max(f1) filter (where run = 'base_1') - max(f1) filter (where run = 'base_2')) as spread
    from x_runs group by 1)
  select 'errors not more' as gate, ne <= errors as passed from p union all select 'macro F1 not lower', nf + 1e-12 >= f1 from p union all select 'macro AUC within limit', na + 0.005 + 1e-12 >= auc from p
  union all select 'F1 drop within limit: ' || event, drop <= greatest(0.02, spread) + 1e-12 from e""")
def _(d):
    from newsgauge.operators.studies import acceptance_gates, run_metrics
    runs = run_metrics(d.labelled, "event", {k: F.expr(v.replace("0.9", "0.9D").replace("0.1", "0.1D")) for k, v in _RUNS.items()}, "truth")
    return acceptance_gates(runs, "event")


@query("rel_vote_variants", f"""with v as (select *, reader::int + judge2::int + judge3::int as n from x_maj where reader is not null),
  a as ({conf('n >= 2', 'v', truth='majority')}), b as ({conf('n >= 1', 'v', truth='majority')})
  select event, 'two of three' as rule, {_F1} as f1 from a union all select event, 'any of three', {_F1} from b""", "f1")
def _(d):
    m = RL.majority(d.labelled, ["truth", "judge2", "judge3"]).filter(F.col("reader").isNotNull())
    n = F.col("reader").cast("int") + F.col("judge2").cast("int") + F.col("judge3").cast("int")
    two = RL.confusion(m, E, n >= 2, "majority", "weight").select("event", F.lit("two of three").alias("rule"), "f1")
    return two.unionByName(RL.confusion(m, E, n >= 1, "majority", "weight").select("event", F.lit("any of three").alias("rule"), "f1"))


@query("rel_completeness", f"""with s as (select *, {U('miss', 'post_id')} >= 0.005 as scored from x_r),
  c as (select event, count(*) filter (where not scored) as missing from s group by 1),
  w as (select event, post_id from x_bandsample where {U('old', 'post_id')} >= 0.01)
  select event, missing, missing <= 5 as complete, (select count(*) from x_bandsample b where b.event = c.event) = (select count(*) from w where w.event = c.event) as sample_is_current from c""")
def _(d):
    from newsgauge.operators.studies import completeness
    cands = d.candidates.select("event", "post_id")
    scored = cands.filter(uniform("miss", F.col("post_id")) >= 0.005)
    banded = RL.width_bands(d.candidates.select("event", "post_id", "score_a"), E, "score_a")
    now = RL.take_per_band(banded, E, "band", "post_id", 10, "17").select("event", "post_id")
    return completeness(cands, scored, now, now.filter(uniform("old", F.col("post_id")) >= 0.01), "event", "post_id")


@query("rel_export_matches", """with k as (select r.event, post_id, cos, score_a, cut from x_r r join (select event, case when event = 'es' then 1.01::double else cut end as cut from x_best) using (event) where event <> 'de')
  select event, post_id, cos, score_a, cut, false as is_empty from k where score_a >= cut union all
  select event, null, null, null, max(cut), true from k group by event having max(score_a) < max(cut)""", "cos score_a")
def _(d):
    from newsgauge.operators.studies import export_matches
    # One event without a positive label and one with an incomplete week, so both rules show.
    best = RL.best_cut(d.labelled, E, "score_a", "truth", "weight")
    cuts = best.select("event", F.when(F.col("event") == "es", F.lit(0.0)).otherwise(F.col("tp")).alias("positives"), "cut")
    return export_matches(d.candidates, cuts, d.candidates.filter("event = 'de'").select("event").distinct(), "event", "post_id", "cos", "score_a")


def _method(name, score, cut):
    return f"""select '{name}' as method, avg(p) as precision, avg(r) as recall, avg(coalesce(2 * p * r / nullif(p + r, 0), 0)) as f1 from (select coalesce(tp / nullif(tp + fp, 0), 0) as p, tp / on_event as r
      from ({conf(f'{score} >= {cut}')}))"""


@query("rel_method_pool", f"""select *, case when method like 'b%' then 0.1 else 0.05 end::double as usd from ({_method('a fixed 0.35', 'score_a', 0.35)} union all {_method('a fixed 0.5', 'score_a', 0.5)}
  union all {_method('b fixed 0.5', 'score_b', 0.5)} union all select 'a best', avg(p), avg(r), avg(coalesce(2 * p * r / nullif(p + r, 0), 0)) from (select coalesce(tp / nullif(tp + fp, 0), 0) as p,
  tp / on_event as r from x_curve join x_best using (event, cut)))""", "precision recall f1")
def _(d):
    from newsgauge.operators.studies import macro_average
    best = RL.best_cut(d.labelled, E, "score_a", "truth", "weight")
    parts = {"a fixed 0.35": RL.confusion(d.labelled, E, F.col("score_a") >= 0.35, "truth", "weight"), "a fixed 0.5": RL.confusion(d.labelled, E, F.col("score_a") >= 0.5, "truth", "weight"),
             "b fixed 0.5": RL.confusion(d.labelled, E, F.col("score_b") >= 0.5, "truth", "weight"), "a best": best}
    return macro_average(parts, {"a fixed 0.35": 0.05, "a fixed 0.5": 0.05, "b fixed 0.5": 0.1, "a best": 0.05})


@query("rel_label_f1", f"""with c as ({conf('reader', '(select * from x_maj where reader is not null)', truth='majority')})
  select event, {_F1} as f1, n as answered, tp + fp as yes_estimate, same from c join (select event, count(*) as n, avg((reader = reader2)::int) as same from x_lab where reader is not null group by 1) using (event)""",
  "f1 yes_estimate same")
def _(d):
    m = RL.majority(d.labelled, ["truth", "judge2", "judge3"]).filter(F.col("reader").isNotNull())
    c = RL.confusion(m, E, F.col("reader"), "majority", "weight").select("event", "f1", F.col("kept").alias("yes_estimate"))
    n = m.groupBy("event").agg(F.count(F.lit(1)).alias("answered"), F.avg((F.col("reader") == F.col("reader2")).cast("int")).alias("same"))
    return c.join(n, "event")


@query("rel_label_cut_overlap", """select event, count(*) as either, count(*) filter (where lab and kept) as both_yes, count(*) filter (where lab is not null and kept is not null and lab = kept) as same_answer,
  count(*) filter (where kept and lab is not null) as kept_labelled from (select r.event, reader as lab, case when score_c >= 0.1 then score_a >= cut end as kept from x_r r join x_best using (event))
  where lab is not null or kept is not null group by 1""")
def _(d):
    labels = d.candidates.filter("reader is not null").select("event", "post_id", F.col("reader").alias("lab"))
    cut = RL.best_cut(d.labelled, E, "score_a", "truth", "weight").select("event", "cut")
    kept = d.candidates.filter("score_c >= 0.1").join(cut, "event").select("event", "post_id", (F.col("score_a") >= F.col("cut")).alias("kept"))
    both = labels.join(kept, ["event", "post_id"], "full")
    return both.groupBy("event").agg(F.count(F.lit(1)).alias("either"), F.count_if(F.col("lab") & F.col("kept")).alias("both_yes"),
                                     F.count_if(F.col("lab") == F.col("kept")).alias("same_answer"), F.count_if(F.col("kept") & F.col("lab").isNotNull()).alias("kept_labelled"))


@query("rel_scorer_compare", f"""with a as (select event, {_SUMMARY} from x_sca join x_curve using (event, cut) group by 1), b as (select event, {_SUMMARY} from x_scb join x_curveb using (event, cut) group by 1),
  ba as (select event, {_F1} as best from x_curve join x_best using (event, cut)), bb as (select event, {_F1} as best from x_curveb join x_bestb using (event, cut)),
  r as (select event, x_auc.auc as auc_a, x_aucb.auc as auc_b, ba.best as best_a, bb.best as best_b, a.f1 as sample_a, b.f1 as sample_b, a.lost as lost_a, b.lost as lost_b, a.extra as extra_a, b.extra as extra_b
    from x_auc join x_aucb using (event) join ba using (event) join bb using (event) join a using (event) join b using (event))
  select * from r union all select 'mean', avg(auc_a), avg(auc_b), avg(best_a), avg(best_b), avg(sample_a), avg(sample_b), avg(lost_a), avg(lost_b), avg(extra_a), avg(extra_b) from r""",
  "auc_a auc_b best_a best_b sample_a sample_b lost_a lost_b extra_a extra_b")
def _(d):
    from newsgauge.operators.studies import compare_scorers
    return compare_scorers(d.labelled, "event", "post_id", {"a": "score_a", "b": "score_b"}, "truth", "weight")


sql_view("x_gaps2", f"""with ref as (select event, {_F1} as f from x_curve join x_best using (event, cut)), r1 as (select event, {_F1} as f from x_curve join x_bestr using (event, cut)),
  r2 as (select event, {_F1} as f from x_curve join x_bestr2 using (event, cut))
  select event, 'reader' as who, r1.f - ref.f as gap from ref join r1 using (event) union all select event, 'reader2', r2.f - ref.f from ref join r2 using (event)""")
sql_view("x_agree", """select event, 'reader' as who, avg((coalesce(reader, truth) = truth)::int) as agree, 0.04::double as usd, count(*) as n from x_lab group by event
  union all select event, 'reader2', avg((reader2 = truth)::int), 0.02::double, count(*) from x_lab group by event""")


@query("rel_reader_gaps", """select who, avg(gap) as mean_gap, min(gap) as worst_gap, arg_min(event, (round(gap, 12), event)) as worst_event, count(*) filter (where gap < -0.02) as behind, avg(agree) as mean_agree, min(agree) as min_agree,
  sum(usd) / sum(n) * 100 as usd_per_100 from x_gaps2 join x_agree using (event, who) group by 1""", "mean_gap worst_gap mean_agree min_agree usd_per_100")
def _(d):
    from newsgauge.operators.studies import reader_gaps
    return reader_gaps(d.labelled, "event", "score_a", "truth", "weight", {"reader": 0.04, "reader2": 0.02})


@query("rel_era_gaps", f"""with g as (select event, case when 2019 + ascii(event) % 6 <= 2022 then 'to 2022' else 'from 2023' end as era, {_F1} as f1, auc from x_curve join x_best using (event, cut) join x_auc using (event))
  select era, count(*) as events, avg(f1) as f1, avg(auc) as auc from g group by 1""", "f1 auc")
def _(d):
    best = RL.best_cut(d.labelled, E, "score_a", "truth", "weight").join(RL.weighted_auc(d.labelled, E, "score_a", "truth", "weight"), "event")
    return RL.era_means(best, F.lit(2019) + F.ascii("event") % 6, ["f1", "auc"])


@query("rel_variant_saving", f"""with f as (select 'full' as variant, event, {_F1} as f1 from ({conf('score_a >= 0.5')}) union all select 'short', event, {_F1} from ({conf('score_b >= 0.5')})),
  t as (select event, avg(chars / 2.2::double) as full_tokens, avg(least(chars, 400) / 2.2::double) as short_tokens from x_r group by 1),
  m as (select variant, avg(case variant when 'full' then full_tokens else short_tokens end) as tokens, avg(f1) as f1 from f join t using (event) group by 1)
  select variant, tokens, 1 - tokens / (select tokens from m where variant = 'full') as saving, f1, f1 - (select f1 from m where variant = 'full') as f1_change from m""", "tokens saving f1 f1_change")
def _(d):
    from newsgauge.operators.studies import variant_saving
    cost = d.candidates.groupBy("event").agg(F.avg(F.col("chars") / 2.2).alias("full"), F.avg(F.least(F.col("chars"), F.lit(400)) / 2.2).alias("short"))
    rows = None
    for name, score in (("full", "score_a"), ("short", "score_b")):
        part = RL.confusion(d.labelled, E, F.col(score) >= 0.5, "truth", "weight").join(cost, "event").select(
            F.lit(name).alias("variant"), "event", F.col(name).alias("tokens"), "f1")
        rows = part if rows is None else rows.unionByName(part)
    return variant_saving(rows, "full")


sql_view("x_ans", f"""select event, case when post_id % 31 = 0 then 'id ' || post_id else ' ' || post_id || ' ' end as raw_id, floor({U('s0', 'post_id')} * 120)::int - 10 as answer, 0 as slice from x_r
  union all select event, post_id::varchar, floor({U('s1', 'post_id')} * 100)::int, 1 from x_r where post_id % 5 = 0""")
sql_view("x_got", """select event, post_id::bigint as post_id, greatest(least(arg_max(answer, slice), 100), 0) as answer from (select event, trim(raw_id) as post_id, answer, slice from x_ans) where regexp_full_match(post_id, '[0-9]+') group by 1, 2""")


def _answers(d):
    c = d.candidates
    raw = F.when(F.col("post_id") % 31 == 0, F.concat(F.lit("id "), "post_id")).otherwise(F.concat(F.lit(" "), F.col("post_id"), F.lit(" ")))
    first = c.select("event", raw.alias("raw_id"), (F.floor(uniform("s0", F.col("post_id")) * 120) - 10).cast("int").alias("answer"), F.lit(0).alias("slice"))
    later = c.filter("post_id % 5 = 0").select("event", F.col("post_id").cast("string").alias("raw_id"), F.floor(uniform("s1", F.col("post_id")) * 100).cast("int").alias("answer"), F.lit(1).alias("slice"))
    return RL.collect_answers(first.unionByName(later), c.select("event", "post_id"), E)


@query("rel_labels_collect", """select r.event, count(*) as asked, count(answer) as answered, count(*) - count(answer) as missing, count(answer) >= 0.95::double * count(*) as accepted, sum(answer)::bigint as answer_sum
  from x_r r left join x_got g using (event, post_id) group by 1""")
def _(d):
    labels, got = _answers(d)
    return got.join(labels.groupBy("event").agg(F.sum("answer").alias("answer_sum")), "event")


@query("rel_shuffle_slices", "select event, post_id, place, (place - 1) // 50 as slice from (select event, post_id, row_number() over (partition by event order by md5('6|' || post_id)) as place from x_r)")
def _(d):
    return RL.slices(d.candidates.select("event", "post_id"), E, "post_id", "6", 50)
