"""Footers, typical phrases, vocabulary and evidence on small fixtures, against brute force."""
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgauge.operators import framing as FR
from newsgauge.operators import texts as X
from newsgauge.operators import vocabulary as V


def test_footers_found_and_stripped(spark):
    rng = random.Random(5)
    posts = []
    for i in range(120):
        body = " ".join(rng.choice("alpha beta gamma delta omega".split()) for _ in range(6)) + f" n{i}"
        tail = " subscribe to us | chan" if i % 2 else ""
        posts.append(("s1", i, body + tail + (" more | chan" if i % 10 == 1 else "")))
    df = spark.createDataFrame(posts, "source string, id bigint, t string")
    found = {(r.ending, r.posts_ending) for r in X.find_footers(df, ["source"], "t").collect()}
    counts = Counter()
    for _, _, t in posts:
        w = t.split(" ")
        for k in range(2, 26):
            if len(w) > k:
                counts[" ".join(w[-k:])] += 1
    marks = [m for m in X.FOOTER_MARKERS]
    want = {(e, c) for e, c in counts.items() if c >= 20 and (any(m in e.lower() for m in marks) or c / 120 >= .3)}
    assert found == want and want
    got = {r.id: r.t for r in X.strip_footers(df, "id", "t", X.find_footers(df, ["source"], "t")).collect()}
    index = {}
    for e, _ in want:
        index.setdefault(" ".join(e.split(" ")[-2:]), []).append(e)
    for _, i, t in posts:
        for _ in range(4):
            for e in sorted(index.get(" ".join(t.split(" ")[-2:]), []), key=len, reverse=True):
                if t.endswith(e) and len(t) > len(e):
                    t = t[:-len(e)].rstrip(X.FOOTER_EDGE)
                    break
            else:
                break
        assert got[i] == t


def test_typical_phrase_over_many_blocks(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(30)]
    rows = [("hot" if i % 3 else "k", i, " ".join(rng.sample(words, rng.randint(5, 12)))) for i in range(200)]
    got = {r.k: r.phrase for r in X.typical_phrase(spark.createDataFrame(rows, "k string, id bigint, p string"), ["k"], "id", "p", first=4, asked_block=8, block=16).collect()}
    for key in ("hot", "k"):
        cand = [(i, p) for k, i, p in rows if k == key and 24 <= len(p) <= 170]
        sets = [set(p.split()) for _, p in cand]
        score = [round(sum(len(a & b) / len(a | b) for b in sets), 9) for a in sets]
        assert got[key] == cand[score.index(max(score))][1]


def test_typical_phrase_of_a_key_with_fifty_thousand(spark, monkeypatch):
    """The best of 50,000 phrases, most of which are never scored; bounds hold the scores of phrases taken at random."""
    rng, n = np.random.default_rng(3), 50_000
    weight = np.cumsum(1 / np.arange(1, 241))
    rows = []
    for i, size in enumerate(rng.integers(6, 15, n).tolist()):
        words = np.unique(np.searchsorted(weight / weight[-1], rng.random(size)))
        rows.append(("k", i, " ".join(f"word{w}" for w in [*words, 300 + i % 7])))      # seven more words, so that few phrases are the same
    rows = [(k, i, p) for k, i, p in rows if 24 <= len(p) <= 170]
    kept = {p: i for _, i, p in reversed(rows)}
    ids = sorted(kept.values())
    words = [set(rows[k][2].split()) for k in range(len(rows))]
    by_id = {i: w for (_, i, _), w in zip(rows, words, strict=True)}
    vocabulary = {w: k for k, w in enumerate(sorted(set().union(*words)))}
    grid = np.zeros((len(ids), len(vocabulary)), np.float32)
    for r, i in enumerate(ids):
        grid[r, [vocabulary[w] for w in by_id[i]]] = 1
    sizes = grid.sum(axis=1)
    some = np.append(rng.choice(len(ids), 300, replace=False), sizes.argmax())
    common = grid[some] @ grid.T
    score = (common / (sizes[some][:, None] + sizes - common)).sum(axis=1, dtype=np.float64)
    asked, whole = [], X._phrase_scores
    monkeypatch.setattr(X, "_phrase_scores", lambda a, *more: asked.append(a.count()) or whole(a, *more))
    df = spark.createDataFrame(rows, "k string, id bigint, p string")
    got = X.typical_phrase(df, ["k"], "id", "p").first()
    mine = grid[ids.index(got.id)] @ grid.T
    best = (mine / (sizes[ids.index(got.id)] + sizes - mine)).sum(dtype=np.float64)
    assert got.overlap == pytest.approx(best, rel=1e-6) and best >= score.max() - 1e-3 and sum(asked) < n / 4
    phrases = spark.createDataFrame([("k", i, sorted(by_id[i])) for i in ids], "k string, _id bigint, _w array<string>")
    bounds = {r._id: (r._low, r._high) for r in X._phrase_bounds(phrases, ["k"]).filter(F.col("_id").isin([ids[k] for k in some])).collect()}
    assert all(bounds[ids[k]][0] - 1e-3 <= s <= bounds[ids[k]][1] + 1e-3 for k, s in zip(some, score, strict=True))
    assert best >= max(low for low, _ in bounds.values()) - 1e-3


def test_interleave_and_budget(spark):
    rows = spark.createDataFrame([(i, "a" if i < 6 else "b", 10) for i in range(9)], "id bigint, g string, cost bigint")
    turned = X.interleave(rows, "g", "id")
    assert [r.id for r in turned.orderBy("place").collect()] == [0, 6, 1, 7, 2, 8, 3, 4, 5]
    assert X.trim_to_budget(turned, "place", "cost", 45).count() == 4


def test_one_channels_habit_is_no_group_term(spark):
    """A word one channel repeats is dropped; a word two channels share in one event is kept, with its posts."""
    rows, n = [], 0
    for event in ("e1", "e2"):
        for group in ("g", "h"):
            for source in ("s1", "s2", "s3"):
                for j in range(5):
                    text = f"common words everywhere {event}{group}{j}"
                    if event == "e1" and group == "g":
                        text += " wildfire" if j < 3 and source != "s3" else ""
                        text += " habitual" if source == "s1" else ""
                    rows.append((event, event, group, group + source, n, text))
                    n += 1
    posts = spark.createDataFrame(rows, "event_id string, event_slug string, media_group string, source_name string, message_id bigint, post_text string")
    tok = V.tokens(posts)
    empty = spark.createDataFrame([], "word string, lemma string")
    lex = V.lexicon(V.distinct_words(tok), spark.createDataFrame([("and",)], "term string"), posts.select("source_name"), empty, empty)
    forms = V.term_forms(tok, lex)
    terms, pww = V.post_terms(forms), V.posts_with_words(posts, tok, posts.select("source_name"))
    st = V.source_terms(pww, terms)
    kept = V.term_scores(pww, st)
    names = {(r.event_id, r.media_group, r.term_key): r for r in kept.filter("term_type = 'word'").collect()}
    assert ("e1", "g", "wildfire") in names and ("e1", "g", "habitual") not in names and not any(k[2] == "common" for k in names)
    w = names["e1", "g", "wildfire"]
    assert (w.posts_with_term, w.sources_with_term, w.other_posts_with_term, w.share_in_group) == (6, 2, 0, 0.4)
    lists = V.term_lists(V.term_posts(pww, terms, kept)).filter("term_key = 'wildfire'").first()
    assert len(lists.post_keys) == 6


def test_evidence_needs_most_of_a_quote(spark):
    text = "The quick brown fox jumps over the lazy dog near the river bank"
    spans = ["quick brown fox jumps", "quick brown cat jumps", "«Quick, brown — fox»", "abc", "the lazy dog near the river bank zz", "zzzzzz yyyyyy"]
    df = spark.createDataFrame([(text, s) for s in spans], "t string, s string")
    df = df.withColumn("tn", FR.normal_form("t")).withColumn("sn", FR.normal_form("s"))
    assert [r.g for r in df.select(FR.grounded(F.col("tn"), F.col("sn")).alias("g")).collect()] == [True, False, True, True, True, False]


def test_bootstrap_interval(spark):
    rng = random.Random(7)
    rows = [("e", "g", i, rng.choice(["n1", "n1", "n2", "n3"])) for i in range(200)]
    df = spark.createDataFrame(rows, "event string, media_group string, message_id bigint, narrative_id string")
    for r in FR.share_intervals(df).collect():
        p = sum(x[3] == r.narrative_id for x in rows) / 200
        half = 1.96 * (p * (1 - p) / 200) ** .5
        assert r.share == pytest.approx(p, abs=6e-4) and not r.directional_only
        assert r.ci_lo == pytest.approx(p - half, abs=0.02) and r.ci_hi == pytest.approx(p + half, abs=0.02)


def test_words_of_a_text_are_counted_where_it_is(spark, monkeypatch):
    """Common and rare words, copies, empty and missing texts; no row of a text is shuffled to be counted."""
    rng = random.Random(11)
    words = ["and", "cat", "cats", "flood", "floods", "river", "s1", "1999", "of", "x"] + [f"word{i}s" for i in range(60)]
    texts = [" ".join(rng.choice(words[:8]) if rng.random() < .7 else rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(80)]
    posts = spark.createDataFrame([("s1", i, t) for i, t in enumerate(texts + texts[:20] + ["", "...", None])], "source_name string, message_id bigint, post_text string")
    split = V.split_texts(posts).cache()
    tok = V.split_tokens(split)
    want, lengths = Counter(), Counter()
    for r in split.collect():
        lengths[r.post_text_id] = sum(len(w) >= 2 for w in r.words)
        want.update((r.post_text_id, a, b) for a, b in zip(r.words, r.words[1:]) if len(a) >= 3 and len(b) >= 3)
    pairs = V.pair_counts(split, 3, "n")
    assert {(r.post_text_id, r.word, r.next_word): r.n for r in pairs.collect()} == want
    assert "hashpartitioning(post_text_id" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert {r.post_text_id: r.words for r in V.text_lengths(split).collect()} == {k: n for k, n in lengths.items() if n}
    dictionary = V.distinct_words(tok).select("word", F.regexp_replace("word", "s$", "").alias("lemma"))
    lex = V.lexicon(V.distinct_words(tok), spark.createDataFrame([("and",)], "term string"), posts.select("source_name"), dictionary, dictionary.limit(0)).cache()
    for of in (1, 30, 10 ** 6):                            # no word, some and all of them are common
        common = V.common_words(lex, V.word_uses(tok), of)
        forms = V.split_forms(split, lex, common)
        rows, plain = ([tuple(r) for r in f.collect()] for f in (forms, V.term_forms(tok, lex)))
        assert Counter(rows) == Counter(plain) and rows
        flags = ["is_stopword", "is_number", "is_source_name"]
        got = V.look_up(tok.drop("next_word"), lex, common, flags, False).select("post_text_id", "word_position", "word", *flags)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, tok.join(lex, "word").select(*got.columns).collect()))


def test_no_term_is_shuffled_by_the_few_keys_of_groups(spark):
    pww = spark.createDataFrame([("e", "e", f"g{i % 2}", f"s{i % 4}", i, f"t{i % 9}") for i in range(60)],
                                "event_id string, event_slug string, media_group string, source_name string, message_id bigint, post_text_id string")
    terms = spark.createDataFrame([(f"t{i}", "word", f"w{j}", 1 + j) for i in range(9) for j in range(i)], "post_text_id string, term_type string, term_key string, term_uses bigint")
    plan = V.term_scores(pww, V.source_terms(pww, terms))._jdf.queryExecution().executedPlan().toString()
    few = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "term_key" not in line and "post_text_id" not in line]
    assert not few, few
