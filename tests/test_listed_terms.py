"""Words, forms and terms counted in a text's own row: the same rows as without lists, and no word of a text shuffled."""
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from newsgauge.operators import vocabulary as V


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df) -> Counter:
    return Counter(map(tuple, df.collect()))


def test_words_are_cut_as_the_expression_cuts_them():
    rng = random.Random(3)
    some = "ab9яёжЀіѓџё é.аяѐёђЯ\n日🙂"
    texts = ["", ".", " a", "a ", "ё"] + ["".join(rng.choice(some) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    want = [re.split(V.WORD_BREAK, t) for t in texts]
    assert V.cut_words(pa.array(texts)).to_pylist() == want
    assert V.cut_words(pa.array(texts).slice(7, 40)).to_pylist() == want[7:47]


def test_splitting_is_what_spark_splits(spark):
    texts = ["İstanbul K Å ẞ", "...", "", "a--b", "ΟΔΟΣ ёж ЁЖ", None, "x" * 40 + " y", "a--b"]
    posts = spark.createDataFrame([(t,) for t in texts], "post_text string")
    want = V.with_text_id(posts.distinct()).select("post_text_id", F.split(F.lower("post_text"), V.WORD_BREAK, -1).alias("words"))
    split = V.split_texts(posts)
    assert rows(split.select("post_text_id", F.to_json("words"))) == rows(want.select("post_text_id", F.to_json("words")))
    assert rows(V.word_uses(split)) == rows(V.word_uses(V.split_tokens(split)))


def test_listed_terms_are_the_flat_ones(spark, monkeypatch):
    """Common and rare words, forms of one term, a dictionary form with a blank so that two pairs are one term, slices of a few texts."""
    monkeypatch.setattr(V, "SLICE_BYTES", 300)
    rng = random.Random(5)
    words = ["and", "cat", "cats", "flood", "floods", "s1", "1999", "of", "x", "new", "york", "newyork", "city"] + [f"word{i}s" for i in range(40)]
    texts = [" ".join(rng.choice(words[:13]) if rng.random() < .7 else rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    posts = [(f"e{i % 2}", f"e{i % 2}", f"g{i % 3}", "s1" if i % 5 else None, i, t) for i, t in enumerate([*texts, *texts[:20], "s1", "s1 s1 x", "", None])]
    posts = spark.createDataFrame(posts, "event_id string, event_slug string, media_group string, source_name string, message_id bigint, post_text string")
    split = V.split_texts(posts).cache()
    tok = V.split_tokens(split)
    dictionary = V.distinct_words(tok).select("word", F.when(F.col("word") == "newyork", "new york").otherwise(F.regexp_replace("word", "s$", "")).alias("lemma"))
    lex = V.lexicon(V.distinct_words(tok), spark.createDataFrame([("and",)], "term string"), posts.select("source_name"), dictionary, dictionary.limit(0)).cache()
    flat = V.term_forms(tok, lex)
    names = posts.select("source_name")
    assert rows(V.posts_with_words(posts, split, names)) == rows(V.posts_with_words(posts, tok, names))
    pww = V.posts_with_words(posts, split, names).cache()
    kept = pww.select(*V.PLACE).distinct().crossJoin(flat.select(*V.TERM).distinct().filter(F.length("term_key") % 2 == 0))
    for of in (1, 30, 10 ** 6):                            # no word, some and all of them are common
        listed = V.listed_forms(split, lex, V.common_words(lex, V.word_uses(split), of)).cache()
        assert rows(V.listed_rows(listed)) == rows(flat)
        terms = V.post_terms(listed)
        assert rows(V.each_term(terms)) == rows(V.post_terms(flat)) and rows(flat)
        assert rows(V.source_terms(pww, terms)) == rows(V.source_terms(pww, V.post_terms(flat)))
        assert rows(V.term_posts(pww, terms, kept)) == rows(V.term_posts(pww, V.post_terms(flat), kept))
    assert "Exchange" not in plan(V.each_term(V.post_terms(listed))).split("InMemoryRelation")[0]


def test_labels_do_not_shuffle_terms_that_did_not_survive(spark):
    posts = spark.createDataFrame([("e", "g", "s", 1, "a", "phrase", "red car")],
                                  "event_id string, media_group string, source_name string, message_id bigint, post_text_id string, term_type string, term_key string")
    forms = spark.createDataFrame([("a", "phrase", "red car", "red cars", 2)], "post_text_id string, term_type string, term_key string, term_form string, term_uses bigint")
    sources = posts.select(*V.PLACE, "source_name", *V.TERM, F.lit(1).cast("long").alias("posts_with_term"), F.rand().alias("_unneeded"))
    labels = V.term_labels(posts, posts, forms, sources)
    assert [r.term_label for r in labels.collect()] == ["red cars"] and plan(labels).count("_unneeded") == 0
    wide = spark.createDataFrame([("e", "g", "s", "phrase", "red car", 1)], "event_id string, media_group string, source_name string, term_type string, term_key string, posts_with_term bigint")
    assert len(re.findall("Scan ExistingRDD", plan(V.term_labels(posts, posts, forms, wide)))) == 4         # phrases twice, their forms, words


def test_terms_are_shuffled_by_the_number_of_a_source(spark):
    """Missing names are a source of their own; a post that comes twice counts twice."""
    posts = [("e", "e", "g", "s1", 1, "a"), ("e", "e", "g", "s1", 1, "a"), ("e", "e", "g", None, 2, "a"), (None, None, None, "s1", 3, "b"), ("f", "f", "g", "s1", 4, "c")]
    posts = spark.createDataFrame(posts, "event_id string, event_slug string, media_group string, source_name string, message_id bigint, post_text_id string")
    terms = spark.createDataFrame([("a", "word", "tree", 2), ("b", "word", "tree", 5)], "post_text_id string, term_type string, term_key string, term_uses bigint")
    found = V.source_terms(posts, terms)
    assert rows(found) == {("e", "g", "s1", "word", "tree", 2, 4): 1, ("e", "g", None, "word", "tree", 1, 2): 1, (None, None, "s1", "word", "tree", 1, 5): 1}
    by_term = [line for line in plan(found).splitlines() if "Exchange hashpartitioning(" in line and "term_key" in line]
    assert by_term and all("hashpartitioning(_own#" in line and "source_name" not in line for line in by_term)


def test_fingerprints_need_the_terms_of_a_text_only(spark):
    from types import SimpleNamespace

    import newsgauge.plans.queries  # noqa: F401
    from newsgauge.plans.catalog import CATALOG
    terms = spark.createDataFrame([("a", 1, ["tree", "red car"], [1, 2])], "post_text_id string, n_words int, term_key array<string>, term_uses array<bigint>")
    assert CATALOG["dq_hash_unique"].plan(SimpleNamespace(terms=terms)).count() == 0
    assert rows(V.each_term(terms)) == {("a", "word", "tree", 1): 1, ("a", "phrase", "red car", 2): 1}
