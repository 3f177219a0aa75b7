"""Blocked ranks, sums, medians and lists against plain Python, with one key and one score holding most rows."""
import random
import statistics

import pytest
from pyspark.sql import functions as F

from newsgauge.operators import scaling as S


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 else f"k{i % 7}"
        score = 0.5 if rng.random() < 0.4 else (None if rng.random() < 0.02 else rng.random())
        rows.append((key, i * 997 % 3_000_017, score, rng.choice([0, 5, 100, -3, 10**6, rng.randint(0, 50)])))
    return rows, spark.createDataFrame(rows, "k string, id bigint, score double, value bigint").cache()


@pytest.mark.parametrize("descending", [True, False])
def test_rank_by_score(hot, descending):
    rows, df = hot
    got = {(r.k, r.id): r["rank"] for r in S.rank_by_score(df, ["k"], "score", "id", 0.0, 1.0, descending=descending, blocks=16).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        mine.sort(key=lambda r: (r[2] is None, 0 if r[2] is None else (-r[2] if descending else r[2]), r[1]))
        want |= {(key, r[1]): n for n, r in enumerate(mine, 1)}
    assert got == want


def test_exact_median(hot):
    rows, df = hot
    got = {r.k: r.m for r in S.exact_median(df, ["k"], "value", "m").collect()}
    assert got == {k: statistics.median([r[3] for r in rows if r[0] == k]) for k in {r[0] for r in rows}}


def test_running_sum_and_id_rank(hot):
    _, df = hot
    d = S.rank_by_id(df, ["k"], "id", "p", bits=12)
    got = S.running_sum(d, "p", "value", "run", ["k"], bits=4).collect()
    for key in {r.k for r in got}:
        total = 0
        for r in sorted((r for r in got if r.k == key), key=lambda r: r.id):
            total += r.value
            assert r.run == total


def test_chunked_list_keeps_every_item(hot):
    _, df = hot
    parts = S.chunked_list(df.withColumn("item", F.col("id").cast("string")), ["k"], "item", "items", chunk=100).collect()
    assert max(len(r["items"]) for r in parts) < 400
    assert sorted(x for r in parts for x in r["items"]) == sorted(str(r.id) for r in df.collect())
