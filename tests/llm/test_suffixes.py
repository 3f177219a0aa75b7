"""Suffix dedup against every stretch of bytes looked up one by one, with buckets so small that tokens are split between them."""
import random

import pytest
from pyspark.sql import functions as F


def brute(rows, least=50):
    """The ids and what is left of each row, in order."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - least + 1 if i is not None else 0):
            s = b[k:k + least]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - least + 1 if i is not None else 0):
            if first[b[k:k + least]] < i:
                gone[k:k + least] = [True] * least
        spans = [k for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])]
        out.append((i, len(b), len(spans), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def texts():
    r = random.Random(5)
    base = "".join(r.choice("abcdeé \n") for _ in range(900))
    passage = "".join(r.choice("xyzß ") for _ in range(120))
    rows = [(1, base), (2, base), (2, base), (3, base[:400] + "#" + base[401:]), (4, None), (5, ""), (6, "short"), (None, base), (None, base), (7, "a" * 3000), (8, "a" * 49), (9, "a" * 50), (10, "b" * 60)]
    rows += [(11 + k, "".join(r.choice("pqrst") for _ in range(r.randrange(80))) + passage[r.randrange(40):80 + r.randrange(40)] + str(k)) for k in range(60)]
    rows += [(100, base[:49]), (101, base[:50]), (102, "ab" * 700), (103, "é" * 200), (50, passage), (50, passage + passage), (-3, passage[20:90]), (0, "é" * 24 + "b"), (104, "xé" * 24 + "é" * 25)]
    rows += [(200 + k, "common words here, that stand in every one of them, " + "".join(r.choice("uvw") for _ in range(200))) for k in range(40)]
    return rows


def got(df):
    return sorted([(r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in df.collect()], key=str)


@pytest.mark.parametrize("bucket", [12 << 20, 4000, 300])
def test_what_is_left_matches_brute_force(spark, bucket):
    from newsgauge.llm.suffixes import without_repeats
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, ident int, spans string").repartition(5)
    assert got(without_repeats(docs, bucket=bucket)) == brute(rows)


def test_spans_cover_what_is_gone(spark):
    from newsgauge.llm.suffixes import without_repeats
    rows = [(1, "q" * 10 + "The same sentence of more than fifty bytes stands in both."), (2, "The same sentence of more than fifty bytes stands in both." + "z")]
    done = {r.doc_id: r for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in done[2].spans] == [(0, 58)] and bytes(done[2].kept) == b"z" and not done[1].spans


def test_long_text_in_pieces_and_empty_table(spark, monkeypatch):
    import newsgauge.llm.suffixes as S
    r = random.Random(6)
    long = "".join(r.choice("abcdefgh ") for _ in range(9000))
    rows = [(1, long), (2, long[:5000] + "!" + long[5000:])]
    monkeypatch.setattr(S, "PIECE", 1000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(S.without_repeats(docs)) == brute(rows)
    assert S.without_repeats(docs.limit(0)).count() == 0
    assert got(S.without_repeats(docs.filter("doc_id = 1"), bucket=500)) == brute(rows[:1])


def test_other_lengths(spark):
    from newsgauge.llm.suffixes import without_repeats
    rows = texts()[:30]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(without_repeats(docs, least=33, bucket=2000)) == brute(rows, 33)
    with pytest.raises(ValueError):
        without_repeats(docs.withColumn("text", F.lit("x")), least=10)
