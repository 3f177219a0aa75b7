"""Ranked search against scores counted document by document, in one block of items and in several."""
import math
import random
import re

import pytest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(t):
    return WORD.findall((t or "").translate(FOLD))


def brute(docs, items, top=20):
    rows = [(i, terms(t)) for i, t in docs if terms(t)]
    n_docs, n_terms = len(rows), sum(len(t) for _, t in rows)
    df = {}
    for _, t in rows:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in set(items):
        scores = []
        for i, t in rows:
            m = 75 + (25 * len(t) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10 ** 9 * t.count(w)) // (1000 * t.count(w) + 12 * m)) for w in terms(text) if w in df)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def tables(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "ÉTÉ", "日本語", "x_y", "a-b", "It's", "Z9"]
    text = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ",", ".", "\n", "\t"]) for _ in range(n))
    docs = [(k, text(r.randrange(1, 60))) for k in range(150)]
    docs += [(1000 + k, docs[3][1]) for k in range(70)] + [(900 - k, docs[4][1] + " outside") for k in range(40)] + [(3, docs[3][1]), (None, docs[3][1]), (None, "w1"), (2000, None), (2001, ""), (2002, " .,-"),
                                                                                                                (2003, "w1 " * 5000)]
    items = [(k, text(r.randrange(1, 25))) for k in range(12)] + [(20, None), (21, ""), (22, "nowhere to be found"), (23, "w1 w1 w1"), (23, "w1 w1 w1"), (24, docs[3][1]), (25, "W1 été")]
    make = lambda rows, name: spark.createDataFrame([(i, t, "a", 1) for i, t in rows], f"{name} long, text string, m string, class_id int").repartition(6)
    return docs, items, make(docs, "doc_id"), make(items, "item_id")


@pytest.mark.parametrize(("top", "block_words"), [(20, 20_000), (3, 50)])
def test_ranks_match_brute_force(spark, top, block_words):
    from newsgauge.llm.bag_search import ranked
    docs, items, d, i = tables(spark)
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in ranked(d, i, top, block_words).collect()), key=str)
    assert got == brute(docs, items, top)


def test_whole_numbers_beyond_doubles(spark, monkeypatch):
    import newsgauge.llm.bag_search as B
    monkeypatch.setattr(B, "EXACT", 1)
    docs, items, d, i = tables(spark)
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in B.ranked(d, i).collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    from newsgauge.llm.bag_search import ranked
    _, _, d, i = tables(spark)
    assert ranked(d.limit(0), i).collect() == [] == ranked(d, i.limit(0)).collect() and ranked(d, i.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
