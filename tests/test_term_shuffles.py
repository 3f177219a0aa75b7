"""The shared term steps: what they shuffle, and that the rows stay the same."""
import re
from collections import Counter

from pyspark.sql import functions as F

from newsgauge.operators import vocabulary as V

FORMS = "post_text_id string, term_type string, term_key string, term_form string, term_uses bigint"


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_common_words_are_sent_whatever_the_threshold(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    lexicon = spark.createDataFrame([("the", "the"), ("cats", "cat"), ("rare", "rar")], "word string, lemma string")
    uses = spark.createDataFrame([("the", 3_000_000), ("cats", 5), ("rare", 1)], "word string, uses bigint")
    rows = spark.createDataFrame([(1, "the"), (1, "cats"), (2, "rare"), (3, "unknown"), (3, None)], "t int, word string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = V.look_up(rows, lexicon, V.common_words(lexicon, uses), ["lemma"], False)
        assert plan(found).count("BroadcastHashJoin") == 2
        assert sorted(map(tuple, found.collect())) == [("cats", 1, "cat"), ("rare", 2, "rar"), ("the", 1, "the")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_both_totals_of_a_term_take_one_shuffle(spark):
    posts = [(f"e{e}", f"e{e}" + "_fulltext" * (e % 2), f"g{g}", f"s{s}", 100 * s + i, f"x{e}{g}{s}{i}") for e in range(4) for g in range(2) for s in range(3) for i in range(6)]
    posts = spark.createDataFrame(posts, "event_id string, event_slug string, media_group string, source_name string, message_id bigint, post_text_id string")
    terms = posts.select("post_text_id", F.when(F.col("message_id") >= 0, "word").otherwise("phrase").alias("term_type"), F.explode(F.array(F.lit("all"), F.concat(F.lit("of"), "event_id", "media_group"))).alias("term_key"), F.lit(2).cast("long").alias("term_uses"))
    kept = V.term_scores(posts, V.source_terms(posts, terms))
    whole = kept._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\((event_id|media_group)#\d+, (same_method#\d+, )?term_type", whole)
    assert len(re.findall(r"Exchange hashpartitioning\(term_type#\d+, term_key", whole)) == 1
    rows = kept.collect()
    assert Counter(r.term_key for r in rows) == {f"ofe{e}g{g}": 1 for e in range(4) for g in range(2)}
    assert {(r.posts_with_term, r.other_posts_with_term, r.other_posts, r.term_uses, r.share_elsewhere) for r in rows} == {(18, 0, 18, 36, 0.0)}


def test_posts_and_labels_need_the_surviving_forms_only(spark):
    forms = spark.createDataFrame([
        ("a", "phrase", "red car", "red cars", 2), ("a", "phrase", "red car", "red car", 1), ("b", "phrase", "red car", "red car", 1),
        ("b", "word", "tree", "trees", 4), ("b", "word", "gone", "gone", 9)], FORMS)
    kept = spark.createDataFrame([("e", "g", "phrase", "red car"), ("e", "g", "word", "tree")], "event_id string, media_group string, term_type string, term_key string")
    posts = spark.createDataFrame([("e", "e", "g", "s", 1, "a"), ("e", "e", "g", "s", 2, "b"), ("f", "f", "g", "s", 3, "b")],
                                  "event_id string, event_slug string, media_group string, source_name string, message_id bigint, post_text_id string")
    mine = V.surviving_forms(forms, kept)
    assert mine.columns == forms.columns and "gone" not in {r.term_key for r in mine.collect()} and mine.count() == 4
    few, all_ = (V.term_posts(posts, V.post_terms(f), kept) for f in (mine, forms))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, all_.collect())) and few.count() == 3
    sources = V.source_terms(posts, V.post_terms(forms))
    few, all_ = (sorted(map(tuple, V.term_labels(kept, few, f, sources).collect())) for f in (mine, forms))
    assert few == all_ == [("e", "g", "phrase", "red car", "red car"), ("e", "g", "word", "tree", "tree")]
