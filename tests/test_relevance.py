"""Cuts, AUC, sampling and stop rules against brute force."""
import random

import pytest

from newsgauge.operators import relevance as RL
from newsgauge.operators import retrieval as RT


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"e{i % 4}", i, round(rng.random(), rng.choice([1, 2, 6])), rng.random() < 0.4, rng.choice([1.0, 2.5, 7.0])) for i in range(600)]
    return rows, spark.createDataFrame(rows, "event string, post_id bigint, score double, truth boolean, weight double").cache()


def brute(rows, cut):
    tp = sum(w for _, _, s, t, w in rows if t and s >= cut)
    fp = sum(w for _, _, s, t, w in rows if not t and s >= cut)
    on = sum(w for _, _, _, t, w in rows if t)
    return 2 * tp / (on + tp + fp) if on + tp + fp else 0.0


def test_best_cut_and_auc(table):
    rows, df = table
    cuts = {r.event: r for r in RL.best_cut(df, ["event"], "score", "truth", "weight").collect()}
    aucs = {r.event: r.auc for r in RL.weighted_auc(df, ["event"], "score", "truth", "weight").collect()}
    for e in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == e]
        cands = sorted({round(r[2], 4) for r in mine})
        best = max(cands, key=lambda c: (round(brute(mine, c), 12), -c))
        assert cuts[e].cut == best and cuts[e].f1 == pytest.approx(brute(mine, best))
        pos, neg = [r for r in mine if r[3]], [r for r in mine if not r[3]]
        area = sum(p[4] * n[4] * (1 if p[2] > n[2] else .5 if p[2] == n[2] else 0) for p in pos for n in neg)
        assert aucs[e] == pytest.approx(area / (sum(p[4] for p in pos) * sum(n[4] for n in neg)))


def test_leave_one_out(table):
    rows, df = table
    for r in RL.leave_one_out_cut(df, "event", "score", "truth", "weight").collect():
        others = [x for x in rows if x[0] != r.event]
        cands = sorted({round(x[2], 4) for x in others})
        assert r.global_cut == max(cands, key=lambda c: (round(brute(others, c), 12), -c))


def test_sample_draws_by_weight(spark, table):
    _, df = table
    picks = RL.sample_picks(df, ["event"], "post_id", "score", "weight", 40, 50).collect()
    per = {}
    for r in picks:
        per.setdefault((r.event, r.seed, r.band), []).append(r)
    assert all(len(v) <= 4 for v in per.values())
    heavy = sum(r.weight == 7.0 for r in picks) / len(picks)
    assert heavy > 0.4          # a third of the posts, far more of the draws
    runs = RL.sample_summary(RL.sample_cut(df, ["event"], "post_id", "score", "truth", "weight", 40, 20), ["event"]).collect()
    best = {r.event: r.f1 for r in RL.best_cut(df, ["event"], "score", "truth", "weight").collect()}
    assert all(r.f1_p10 <= r.f1 <= best[r.event] + 1e-9 for r in runs)


def test_reservoirs_read_each_row_once_and_draw_by_weight(spark, monkeypatch):
    rng = random.Random(12)
    rows = [("e", i, 0.5, rng.random() < 0.5, 1.0 if i % 4 else 9.0) for i in range(400)]
    df = spark.createDataFrame(rows, "event string, post_id bigint, score double, truth boolean, weight double")
    one, many = (sorted((r.seed, r.post_id) for r in RL.sample_picks(df.repartition(k), ["event"], "post_id", "score", "weight", 20, 400, chunk=c).collect()) for k, c in ((1, 4096), (7, 11)))
    assert one == many and len(one) == 2 * 400                               # the same posts, however the rows lie
    first = sum(i % 4 == 0 for _, i in one) / len(one)                       # 100 of weight 9 and 300 of weight 1: 0.75 for the first, 0.7493 for the second draw
    assert first == pytest.approx(0.7496, abs=0.05)
    plan = RL.sample_picks(df, ["event"], "post_id", "score", "weight", 20, 400)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInPandas") == 1         # rows go in as they are, not once for every seed


def test_stop_rule_ends_after_the_first_poor_batch(spark):
    scores = [1.0] * 10 + [0.0] * 5 + [1.0] * 10
    df = spark.createDataFrame([("e", i + 1, s) for i, s in enumerate(scores)], "event string, rank bigint, score double")
    assert RL.stop_rule(df, ["event"], "rank", "score", 5, 0.5).first().depth == 15
    assert RL.stop_rule(df, ["event"], "rank", "score", 5, 0.0).first().depth == 25


def test_rejects_and_collects_answers(spark):
    answers = spark.createDataFrame([("e", " 1 ", 150, 0), ("e", "1", 20, 1), ("e", "x2", 5, 0), ("e", "3", -4, 0)], "event string, raw_id string, answer int, slice int")
    asked = spark.createDataFrame([("e", i) for i in (1, 2, 3)], "event string, post_id bigint")
    labels, got = RL.collect_answers(answers, asked, ["event"])
    assert {r.post_id: r.answer for r in labels.collect()} == {1: 20, 3: 0}
    r = got.first()
    assert (r.asked, r.answered, r.missing, r.accepted) == (3, 2, 1, False)


def test_probe_scores_in_many_blocks(spark):
    rng = random.Random(4)
    unit = lambda v: [x / sum(y * y for y in v) ** .5 for x in v]
    vecs = [(i, i % 3 and 1, unit([rng.gauss(0, 1) for _ in range(8)])) for i in range(300)]
    probes = [(e, w, p, unit([rng.gauss(0, 1) for _ in range(8)])) for e, w in ((1, 0), (2, 1), (3, 1)) for p in range(3)]
    v = spark.createDataFrame(vecs, "id bigint, window int, vector array<double>")
    q = spark.createDataFrame(probes, "event_id int, window int, probe int, probe_vector array<double>")
    whole, dealt = ({(r.event_id, r.id): (round(r.score, 9), r.probe) for r in RT.probe_scores(v, q, "window", "id", "vector", rows_per_block=sizes[0], probes_per_block=sizes[1]).collect()}
                    for sizes in ((4096, 256), (20, 2)))
    want = {}
    for e in (1, 2, 3):
        mine = [p for p in probes if p[0] == e]
        for i, w, vec in vecs:
            if w == mine[0][1]:
                s = [sum(a * b for a, b in zip(vec, p[3])) for p in mine]
                want[e, i] = (round(max(s), 9), s.index(max(s)))
    assert whole == want and dealt == want
    sizes = {"rows_per_block": 20, "probes_per_block": 2}
    pooled = {}
    for (e, i), (score, probe) in want.items():
        pooled[e, i // 4] = min(pooled.get((e, i // 4), (9, 9)), (-score, probe))
    posts = RT.probe_scores(v.withColumn("post", (v.id / 4).cast("bigint")), q, "window", "post", "vector", **sizes).collect()
    assert {(r.event_id, r.id): (-round(r.score, 9), r.probe) for r in posts} == pooled
    few = RT.probe_scores(v, q, "window", "id", "vector", top_k=5, floor=0.3, **sizes)
    got = {(r.event_id, r.id, round(r.score, 9), r.rank) for r in RT.candidates(few.drop("probe"), ["event_id"], "score", "id", top_k=5).collect()}
    ranked = {(e, i, s, k) for e in (1, 2, 3) for k, (s, i) in enumerate(sorted(((s, i) for (e2, i), (s, _) in want.items() if e2 == e and s >= 0.3), key=lambda x: (-x[0], x[1]))[:5], 1)}
    assert got == ranked
    for sums in (RT.probe_summary(v, q, "window", "id", "vector", **sizes), RT.probe_summary(v, q, "window", "id", "vector")):
        for r in sums.collect():
            mine = [s for (e, _), (s, _) in want.items() if e == r.event_id]
            assert (r.scored, round(r.best, 9)) == (len(mine), max(mine)) and r.mean_best == pytest.approx(sum(mine) / len(mine))


def test_no_more_than_k_rows_of_an_event_leave_a_block(spark, monkeypatch):
    rng = random.Random(9)
    v = spark.createDataFrame([(i, 0, [rng.gauss(0, 1) for _ in range(4)]) for i in range(400)], "id bigint, window int, vector array<double>")
    q = spark.createDataFrame([(e, 0, 0, [rng.gauss(0, 1) for _ in range(4)]) for e in range(3)], "event_id int, window int, probe int, probe_vector array<double>")
    few = RT.probe_scores(v, q, "window", "id", "vector", top_k=2, rows_per_block=100)
    assert few.count() <= 4 * 3 * 2 and RT.probe_scores(v, q, "window", "id", "vector", rows_per_block=100).count() == 1200
