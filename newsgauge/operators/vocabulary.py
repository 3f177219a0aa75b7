"""Which words set one media group apart: tokens, terms, scores, labels and the posts behind them.

Texts are split once per distinct text, words are looked up once per distinct word, copies of a text
are counted before they meet its terms, and only surviving terms ever meet their posts again.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.operators.scaling import chunked_list, rank_in_blocks, score_block
from newsgauge.session import summary

WORD_BREAK = "[^a-zа-яё0-9]+"
USABLE = "not is_stopword and not is_number and not is_source_name"
TERM = ["term_type", "term_key"]
PLACE = ["event_id", "media_group"]
SLICE_BYTES = 6 << 20                 # of words that a Python task counts at a time; a longer text is a slice of its own
LISTED = ("post_text_id string, n_words int, term_key array<string>, term_uses array<bigint>, "
          "word_form array<string>, word_at array<int>, word_uses array<bigint>, phrase_form array<string>, phrase_at array<int>, phrase_uses array<bigint>")


def with_text_id(posts: DataFrame) -> DataFrame:
    return posts.filter(F.col("post_text").isNotNull()).withColumn("post_text_id", F.md5("post_text"))


# What WORD_BREAK leaves, in UTF-8: the bytes of a-z and 0-9, and two bytes for а-я and ё.
_PLAIN = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
_PAIR = {0xD0: (np.arange(256) >= 0xB0) & (np.arange(256) <= 0xBF), 0xD1: (np.arange(256) >= 0x80) & (np.arange(256) <= 0x8F) | (np.arange(256) == 0x91)}


def cut_words(texts: pa.Array) -> pa.Array:
    """Lists of what stands between the breaks of lower-case texts, as Java's split by WORD_BREAK gives them with a limit of -1: a break
    at an end of a text leaves an empty word there. Breaks are found on the bytes of all texts at once."""
    n, texts = len(texts), texts.cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    held = _PLAIN[raw]
    for lead, after in _PAIR.items():
        at = np.flatnonzero(raw[:-1] == lead)
        at = at[after[raw[at + 1]]]
        held[at] = held[at + 1] = True
    before = np.concatenate(([0], np.cumsum(held)))                               # kept bytes before each place
    first = ~held
    first[1:] &= held[:-1]
    opens = ends[:-1][ends[:-1] < len(raw)]
    first[opens] = ~held[opens]                                                   # a break does not reach over the end of a text
    breaks = np.flatnonzero(first)
    places = np.sort(np.concatenate([2 * breaks + 1, 2 * ends[1:]]), kind="stable") >> 1     # a word ends at a break and at the end of its text
    values = pa.StringArray.from_buffers(len(places), pa.py_buffer(np.concatenate(([0], before[places])).astype(np.int32)), pa.py_buffer(raw[held]))
    counts = np.diff(np.searchsorted(breaks, ends)) + 1
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values)


def split_texts(posts: DataFrame) -> DataFrame:
    """Each distinct text once, as the list of its words in order."""
    def cut(batches):
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("post_text_id"), cut_words(b.column("words"))], names=["post_text_id", "words"])
    texts = with_text_id(posts.select("post_text").distinct())
    return texts.select("post_text_id", F.lower("post_text").alias("words")).mapInArrow(cut, "post_text_id string, words array<string>")


def _pairs() -> Column:
    """Every word with the word right after it, which is NULL for the last one."""
    return F.arrays_zip(F.col("words").alias("word"), F.slice(F.col("words"), F.lit(2), F.size("words")).alias("next_word"))


def split_tokens(split: DataFrame) -> DataFrame:
    """The words of each split text with their 1-based place and the word right after.

    The neighbour is taken from the list, so pairs need no join and no window. Only words of two
    characters or more are rows; places still count the dropped ones.
    """
    return (
        split.select("post_text_id", F.posexplode(_pairs()).alias("i", "p"))
        .select("post_text_id", (F.col("i") + 1).alias("word_position"), F.col("p.word").alias("word"), F.col("p.next_word").alias("next_word"))
        .filter(F.length("word") >= 2)
    )


def tokens(posts: DataFrame) -> DataFrame:
    """The words of each distinct text of some posts."""
    return split_tokens(split_texts(posts))


def _counted(split: DataFrame, items: Column, out: str) -> DataFrame:
    """Each text's distinct items with how often it holds them.

    A text is one row, so its items are sorted and counted there: no row of a text is shuffled, and memory
    holds one text at a time.
    """
    first = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)))
    # Texts without an item have no places. As a filter that would be pushed below the sort, which would then run twice.
    runs = split.select("post_text_id", F.sort_array(items).alias("_s")).select("post_text_id", "_s", F.when(F.size("_s") > 0, first).alias("_at"))
    counted = F.transform("_at", lambda i, k: F.struct(
        F.get("_s", i).alias("item"), (F.coalesce(F.get("_at", k + 1), F.size("_s")) - i).cast("long").alias("uses")))
    return runs.select("post_text_id", F.explode(counted).alias("c")).select("post_text_id", F.col("c.item").alias("item"), F.col("c.uses").alias(out))


def word_counts(split: DataFrame, at_least: int, out: str = "term_uses") -> DataFrame:
    """(post_text_id, word, uses) of the words of so many characters."""
    return _counted(split, F.filter("words", lambda w: F.length(w) >= at_least), out).withColumnRenamed("item", "word")


def pair_counts(split: DataFrame, at_least: int, out: str = "term_uses") -> DataFrame:
    """(post_text_id, word, next_word, uses) of neighbours that both have so many characters."""
    def joined(word: Column, after: Column) -> Column:      # words hold no blank, and plain strings sort much faster than pairs
        return F.when((F.length(word) >= at_least) & (F.length(after) >= at_least), F.concat_ws(" ", word, after))

    both = F.array_compact(F.zip_with("words", F.slice("words", 2, F.size("words")), joined))
    return _counted(split, both, out).select(
        "post_text_id", F.substring_index("item", " ", 1).alias("word"), F.substring_index("item", " ", -1).alias("next_word"), out)


def text_lengths(split: DataFrame, at_least: int = 2) -> DataFrame:
    """How many words of so many characters each text has; a text without any is left out."""
    n = F.size(F.filter("words", lambda w: F.length(w) >= at_least)).cast("long")
    return split.select("post_text_id", n.alias("words")).filter("words > 0")


def lemmas(words: DataFrame, dictionary: DataFrame, overrides: DataFrame) -> DataFrame:
    """Distinct word to dictionary form; an override wins; a word in neither is left out."""
    d = dictionary.select("word", F.col("lemma").alias("_d")).dropDuplicates(["word"])
    o = overrides.select("word", F.col("lemma").alias("_o")).dropDuplicates(["word"])
    return (
        words.select("word").distinct().join(d, "word", "left").join(o, "word", "left")
        .filter(F.col("_d").isNotNull() | F.col("_o").isNotNull())
        .select("word", F.coalesce("_o", "_d").alias("lemma"), F.when(F.col("_o").isNotNull(), "override").otherwise("dictionary").alias("lemma_source")))


def distinct_words(tokens: DataFrame) -> DataFrame:
    return tokens.select("word").distinct()


def word_uses(tokens: DataFrame) -> DataFrame:
    """Every distinct word of two characters or more with its uses, from tokens or from split texts, whose words are counted where they lie."""
    if "words" not in tokens.columns:
        return tokens.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))

    def count(batches):
        for b in _slices(batches):
            found = pc.value_counts(pc.split_pattern(b.column("words"), " ").flatten())
            word, uses = found.flatten()
            yield pa.RecordBatch.from_arrays([word, uses], names=["word", "uses"]).filter(pc.greater_equal(pc.utf8_length(word), 2))
    return _as_text(tokens).mapInArrow(count, "word string, uses bigint").groupBy("word").agg(F.sum("uses").alias("uses"))


def common_words(lexicon: DataFrame, uses: DataFrame, of: int = 1_000_000) -> DataFrame:
    """The lexicon of the words that make up a millionth of all words or more each, so there are at most a million."""
    total = uses.agg(F.sum("uses").alias("_all"))
    often = uses.crossJoin(F.broadcast(total)).filter(F.col("uses") >= F.col("_all") / F.lit(of)).select("word")     # total is one row
    return summary(lexicon.join(often, "word", "left_semi"))


def look_up(rows: DataFrame, lexicon: DataFrame, common: DataFrame, take: list[str], usable: bool, word: str = "word") -> DataFrame:
    """Rows with what the lexicon says of a word; rows whose word it does not have (or that cannot be used) are gone.

    Nearly all rows hold a common word. Those are a million at most (`common_words`) and are sent to every task whatever
    the broadcast threshold, so that these rows stay in the order of their texts; only rows with a rare word are shuffled.
    """
    own = [c for c in rows.columns if c != word]

    def known(words: DataFrame) -> DataFrame:
        return (words.filter(USABLE) if usable else words).select(F.col("word").alias(word), *take)

    rare = lexicon.join(common.select("word"), "word", "left_anti")
    far = rows.join(F.broadcast(common.select(F.col("word").alias(word))), word, "left_anti")
    return rows.join(F.broadcast(known(common)), word).unionByName(far.join(known(rare), word)).select(word, *own, *take)


def lexicon(words: DataFrame, stopwords: DataFrame, source_names: DataFrame, dictionary: DataFrame, overrides: DataFrame) -> DataFrame:
    """Every distinct word once, with its flags and the form it is counted under."""
    flagged = (
        words.join(stopwords.select(F.col("term").alias("word"), F.lit(True).alias("_s")).distinct(), "word", "left")
        .join(source_names.select(F.col("source_name").alias("word"), F.lit(True).alias("_n")).distinct(), "word", "left")
        .select("word", F.coalesce("_s", F.lit(False)).alias("is_stopword"), F.col("word").rlike("^[0-9]+$").alias("is_number"),
                F.coalesce("_n", F.lit(False)).alias("is_source_name")))
    countable = flagged.filter(~F.col("is_stopword") & ~F.col("is_number") & ~F.col("is_source_name") & (F.length("word") >= 3))
    return flagged.join(lemmas(countable, dictionary, overrides), "word", "left").withColumn("lemma", F.coalesce("lemma", "word"))


def _forms(words: DataFrame, phrases: DataFrame) -> DataFrame:
    return words.select("post_text_id", F.lit("word").alias("term_type"), F.col("lemma").alias("term_key"), F.col("word").alias("term_form"), "term_uses").unionByName(
        phrases.select("post_text_id", F.lit("phrase").alias("term_type"), F.concat_ws(" ", "lemma", "next_lemma").alias("term_key"),
                       F.concat_ws(" ", "word", "next_word").alias("term_form"), "term_uses"))


def term_forms(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One spelling of one word or two-word phrase in one distinct text, with its uses."""
    known = lexicon.filter(USABLE).select("word", "lemma")
    after = known.select(F.col("word").alias("next_word"), F.col("lemma").alias("next_lemma"))
    uses = F.count(F.lit(1)).alias("term_uses")
    return _forms(
        tokens.filter(F.length("word") >= 4).groupBy("post_text_id", "word").agg(uses).join(known, "word"),
        tokens.filter((F.length("word") >= 3) & (F.length("next_word") >= 3)).groupBy("post_text_id", "word", "next_word").agg(uses)
        .join(known, "word").join(after, "next_word"))


def _as_text(split: DataFrame, *more: str) -> DataFrame:
    """Words travel as one string, a blank between two; no word holds one."""
    return split.select("post_text_id", F.array_join("words", " ").alias("words"), *more)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            part = np.cumsum(pc.binary_length(b.column("words")).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE_BYTES
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            for i, j in zip(starts, [*starts[1:], b.num_rows], strict=True):
                yield b.slice(i, j - i)


def _numbered(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text of each word, number of each word, the distinct words) of texts whose words are one string."""
    split = pc.split_pattern(words, " ")
    coded = split.flatten().dictionary_encode()
    text = np.repeat(np.arange(len(words)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    return text, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _summed(text: np.ndarray, item: np.ndarray, kinds: int, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, total) of each distinct pair, texts in order."""
    if n is None:
        pairs, total = np.unique(text * kinds + item, return_counts=True)
    else:
        pairs, place = np.unique(text * kinds + item, return_inverse=True)
        total = np.bincount(place, n, len(pairs)).astype(np.int64)
    return pairs // max(kinds, 1), pairs % max(kinds, 1), total


def _lists(text: np.ndarray, n: int, *columns: pa.Array) -> list[pa.Array]:
    """Lists for each of n texts, from columns in the order of the texts."""
    ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n)))).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, c) for c in columns]


def _listed(ids: pa.Array, words: pa.Array, rare: pa.Array, common_word: pa.Array, common_lemma: pa.Array) -> pa.RecordBatch:
    """The forms and terms of some texts: every step is over numbers of words and of pairs, strings are made once for each distinct one."""
    n = len(ids)
    text, code, word = _numbered(words)
    rare_word, rare_lemma = rare.flatten().flatten()
    lemma = pc.coalesce(common_lemma.take(pc.index_in(word, value_set=common_word)), rare_lemma.take(pc.index_in(word, value_set=rare_word)))
    known, chars = pc.is_valid(lemma).to_numpy(zero_copy_only=False), pc.utf8_length(word).to_numpy(zero_copy_only=False)
    coded = lemma.dictionary_encode()
    under, lemmas = pc.fill_null(coded.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    held = (known & (chars >= 4))[code]
    w_text, w, w_uses = _summed(text[held], code[held], len(word))
    wt_text, wt, wt_uses = _summed(w_text, under[w], len(lemmas), w_uses)

    held = (known & (chars >= 3))[code]
    held = held[:-1] & held[1:] & (text[:-1] == text[1:])
    pairs, pair = np.unique(code[:-1][held] * len(word) + code[1:][held], return_inverse=True)
    a, b = pairs // max(len(word), 1), pairs % max(len(word), 1)
    spelled = pc.binary_join_element_wise(word.take(pa.array(a)), word.take(pa.array(b)), " ")
    keys = pc.binary_join_element_wise(lemmas.take(pa.array(under[a])), lemmas.take(pa.array(under[b])), " ").dictionary_encode()     # two pairs may be one term
    key_of, phrases = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64), keys.dictionary
    p_text, p, p_uses = _summed(text[:-1][held], pair, len(pairs))
    pt_text, pt, pt_uses = _summed(p_text, key_of[p], len(phrases), p_uses)

    of = np.concatenate([wt_text, pt_text])
    order = np.argsort(of, kind="stable")                                        # a text's words, then its phrases
    terms = pa.concat_arrays([lemmas.take(pa.array(wt)), phrases.take(pa.array(pt))]).take(pa.array(order))
    n_words, starts = np.bincount(wt_text, minlength=n), [np.concatenate(([0], np.cumsum(np.bincount(t, minlength=n)))) for t in (wt_text, pt_text)]
    w_at = np.searchsorted(wt_text * len(lemmas) + wt, w_text * len(lemmas) + under[w]) - starts[0][w_text]
    p_at = np.searchsorted(pt_text * len(phrases) + pt, p_text * len(phrases) + key_of[p]) - starts[1][p_text] + n_words[p_text]
    return pa.RecordBatch.from_arrays([
        ids, pa.array(n_words.astype(np.int32)),
        *_lists(of, n, terms, pa.array(np.concatenate([wt_uses, pt_uses])[order])),
        *_lists(w_text, n, word.take(pa.array(w)), pa.array(w_at.astype(np.int32)), pa.array(w_uses)),
        *_lists(p_text, n, spelled.take(pa.array(p)), pa.array(p_at.astype(np.int32)), pa.array(p_uses)),
    ], names=[c.split()[0] for c in LISTED.split(", ")])


def listed_forms(split: DataFrame, lexicon: DataFrame, common: DataFrame) -> DataFrame:
    """A row for each text with its forms (`term_forms`) and terms (`post_terms`) as lists.

    Common words go to every task (a million at most, `common_words`). A text's rare words are looked up apart and come back to
    it as one short list, so a text's words, pairs and terms are counted in its own row and none of them is shuffled.
    """
    sent = common.select("word", F.when(F.expr(USABLE), F.col("lemma")).alias("lemma")).toArrow()
    common_word, common_lemma = (sent.column(c).combine_chunks().cast(pa.string()) for c in ("word", "lemma"))

    def uncommon(batches):
        for b in _slices(batches):
            text, code, word = _numbered(b.column("words"))
            far = pc.invert(pc.is_in(word, value_set=common_word)).to_numpy(zero_copy_only=False) & (pc.utf8_length(word).to_numpy(zero_copy_only=False) >= 3)
            held = far[code]
            of, w, _ = _summed(text[held], code[held], len(word))
            yield pa.RecordBatch.from_arrays([b.column("post_text_id").take(pa.array(of)), word.take(pa.array(w))], names=["post_text_id", "word"])

    def count(batches):
        for b in _slices(batches):
            yield _listed(b.column("post_text_id"), b.column("words"), b.column("rare"), common_word, common_lemma)

    rare = lexicon.filter(USABLE).select("word", "lemma").join(common.select("word"), "word", "left_anti")
    found = _as_text(split).mapInArrow(uncommon, "post_text_id string, word string").join(rare, "word")
    by_text = found.groupBy("post_text_id").agg(F.collect_list(F.struct("word", "lemma")).alias("rare"))
    return _as_text(split).join(by_text, "post_text_id", "left").mapInArrow(count, LISTED)


def _forms_of(listed: DataFrame, kind: str) -> DataFrame:
    form, at, uses = (f"{kind}_{c}" for c in ("form", "at", "uses"))
    each = listed.select("post_text_id", "term_key", at, uses, F.posexplode(form).alias("_i", "term_form"))
    return each.select("post_text_id", F.lit(kind).alias("term_type"), F.get("term_key", F.get(at, F.col("_i"))).alias("term_key"), "term_form", F.get(uses, F.col("_i")).alias("term_uses"))


def phrase_forms(listed: DataFrame) -> DataFrame:
    return _forms_of(listed, "phrase")


def listed_rows(listed: DataFrame) -> DataFrame:
    """`term_forms` out of their lists."""
    return _forms_of(listed, "word").unionByName(_forms_of(listed, "phrase"))


def split_forms(split: DataFrame, lexicon: DataFrame, common: DataFrame) -> DataFrame:
    """`term_forms` of split texts: uses are counted inside a text, and only rare words are shuffled."""
    return listed_rows(listed_forms(split, lexicon, common))


def post_terms(forms: DataFrame) -> DataFrame:
    """Uses per text and term. Listed forms keep them as lists in the text's row; else they are kept together by text, which is how posts will ask for them."""
    if "n_words" in forms.columns:
        return forms.select("post_text_id", "n_words", "term_key", "term_uses")
    return forms.repartition("post_text_id").groupBy("post_text_id", *TERM).agg(F.sum("term_uses").alias("term_uses"))


def each_term(rows: DataFrame) -> DataFrame:
    """A row for each term of listed terms; other rows as they are."""
    if "n_words" not in rows.columns:
        return rows
    own = [c for c in rows.columns if c not in ("n_words", "term_key", "term_uses")]
    each = rows.select(*own, "n_words", "term_uses", F.posexplode("term_key").alias("_i", "term_key"))
    kind = F.when(F.col("_i") < F.col("n_words"), "word").otherwise("phrase")
    return each.select(*own, kind.alias("term_type"), "term_key", F.get("term_uses", F.col("_i")).alias("term_uses"))


def surviving_forms(forms: DataFrame, kept: DataFrame) -> DataFrame:
    """The spellings of surviving terms: what posts and labels need of `forms`, found in one shuffle on the term."""
    return forms.join(kept.select(*TERM).distinct(), TERM[::-1], "left_semi").select(forms.columns)


def posts_with_words(posts: DataFrame, tokens: DataFrame, source_names: DataFrame) -> DataFrame:
    """Posts with at least one word that is not a source's name: the denominator of every share.

    `tokens` may be split texts: then a text's first word is asked first, and all words only of texts that begin with a name.
    """
    names = summary(source_names.select(F.col("source_name").alias("word")).distinct())
    if "words" in tokens.columns:
        begun = summary(tokens.select("post_text_id", F.get(F.filter("words", lambda w: F.length(w) >= 2), F.lit(0)).alias("word")).filter("word is not null"))
        named = tokens.join(begun.join(names, "word", "left_semi"), "post_text_id", "left_semi")
        rest = named.select("post_text_id", F.explode("words").alias("word")).filter(F.length("word") >= 2).join(names, "word", "left_anti")
        texts = begun.join(names, "word", "left_anti").select("post_text_id").unionByName(rest.select("post_text_id").distinct())
    else:
        texts = tokens.select("post_text_id", "word").join(names, "word", "left_anti").select("post_text_id").distinct()
    return with_text_id(posts).join(texts, "post_text_id", "left_semi").select(
        "event_id", "event_slug", "media_group", "source_name", "message_id", "post_text_id")


def source_terms(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """Posts and uses per source and term; copies of one text are counted before the join.

    Sources of an event and group are numbered, so that terms are grouped and shuffled with one number instead of three names.
    """
    own = [*PLACE, "source_name"]
    numbers = summary(posts.select(*own).distinct().withColumn("_own", F.monotonically_increasing_id()))
    named = numbers.select("_own", *[F.col(c).alias(f"_{c}") for c in own])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own]                    # names may be missing
    copies = posts.groupBy(*own, "post_text_id").agg(F.count(F.lit(1)).alias("_n")).join(named, same).select("_own", "post_text_id", "_n")
    found = each_term(copies.join(terms, "post_text_id")).groupBy("_own", *TERM).agg(
        F.sum("_n").alias("posts_with_term"), F.sum(F.col("_n") * F.col("term_uses")).alias("term_uses"))
    return found.join(numbers, "_own").select(*own, *TERM, "posts_with_term", "term_uses")


def term_scores(posts: DataFrame, source_terms: DataFrame, smoothing: float = 0.02, min_posts: int = 3, min_group_posts: int = 10,
                min_specificity: float = 0.4, max_top_share: float = 0.7, fulltext_suffix: str = "_fulltext") -> DataFrame:
    """The terms one event brought into one group's vocabulary, with how far they set it apart.

    "Other events" are those matched by the same method. Terms that fail the cheap filters are gone
    before the totals are joined.
    """
    per_source = summary(posts.groupBy("event_id", "event_slug", "media_group", "source_name").agg(F.count(F.lit(1)).alias("n")))
    # Figures of groups, sources and events are written, so that no term is shuffled by the few keys of them.
    groups = summary(per_source.groupBy("event_id", "event_slug", "media_group").agg(
        F.sum("n").alias("group_posts"), F.count(F.lit(1)).alias("group_sources")).withColumn(
        "same_method", F.col("event_slug").endswith(fulltext_suffix)).drop("event_slug"))
    source_posts = summary(per_source.groupBy("event_id", "source_name").agg(F.sum("n").alias("source_posts")))
    group_totals = summary(groups.groupBy("media_group", "same_method").agg(F.sum("group_posts").alias("group_posts_all")))
    event_totals = summary(groups.groupBy("event_id").agg(F.sum("group_posts").alias("event_posts")))
    # Sums by place and term combine before the shuffle, so that a term of all events and sources is in no one task.
    by_term = source_terms.join(source_posts, ["event_id", "source_name"])
    all_terms = by_term.groupBy(*PLACE, *TERM).agg(
        F.sum("posts_with_term").alias("posts_with_term"), F.count(F.lit(1)).alias("sources_with_term"), F.sum("term_uses").alias("term_uses"),
        F.max(F.col("posts_with_term").cast("double") / F.col("source_posts")).alias("max_share_within_one_source"),
        (F.max("posts_with_term").cast("double") / F.nullif(F.sum("posts_with_term"), F.lit(0))).alias("top_source_share_of_term"))
    carried, term = F.sum("posts_with_term"), TERM[::-1]                     # keys begin alike far less often than types, so they sort faster
    passes = (
        (F.col("posts_with_term") >= min_posts) & (F.col("group_posts") >= min_group_posts)
        & (F.col("sources_with_term") >= F.least(F.lit(2), F.col("group_sources")))
        & ((F.col("group_sources") < 3) | (F.col("top_source_share_of_term") <= max_top_share)))
    # Both totals take one more shuffle, on the term: a task holds one row of it for each event and group at most.
    # Most terms pass nowhere; they are gone after one sort, before the totals.
    passing = (
        all_terms.join(groups, PLACE).repartition(*TERM)
        .withColumn("_some", F.max(passes.cast("int")).over(Window.partitionBy(*term))).filter("_some = 1").drop("_some")
        .withColumn("event_posts_with_term", carried.over(Window.partitionBy(*term, "event_id")))
        .withColumn("group_posts_with_term", carried.over(Window.partitionBy(*term, "media_group", "same_method")))
        .filter(passes))
    other, others = F.col("event_posts_with_term") - F.col("posts_with_term"), F.col("event_posts") - F.col("group_posts")
    mine_elsewhere, mine_all = F.col("group_posts_with_term") - F.col("posts_with_term"), F.col("group_posts_all") - F.col("group_posts")

    def lift(against: str):
        return F.log2((F.col("share_in_group") + smoothing) / (F.coalesce(F.col(against), F.lit(0.0)) + smoothing))

    return (
        passing.join(group_totals, ["media_group", "same_method"]).join(event_totals, "event_id")
        .select(
            *PLACE, *TERM, "posts_with_term", "sources_with_term", "term_uses", "max_share_within_one_source", "top_source_share_of_term",
            "group_posts", "group_sources", other.alias("other_posts_with_term"), others.alias("other_posts"),
            (F.col("posts_with_term").cast("double") / F.col("group_posts")).alias("share_in_group"),
            F.when(others > 0, other.cast("double") / others).alias("share_elsewhere"),
            F.when(mine_all > 0, mine_elsewhere.cast("double") / mine_all).alias("share_in_group_other_events"))
        .withColumn("distinctiveness", lift("share_elsewhere")).withColumn("event_specificity", lift("share_in_group_other_events"))
        .filter(F.col("event_specificity") >= min_specificity)
    )


def term_posts(posts: DataFrame, terms: DataFrame, kept: DataFrame) -> DataFrame:
    """Posts carrying a surviving term; a term outside the survivors never meets a post."""
    survivors = kept.select(*PLACE, *TERM)
    if "n_words" in terms.columns:
        carrying = each_term(posts.join(terms, "post_text_id"))
    else:
        carrying = posts.join(terms.join(survivors.select(*TERM).distinct(), TERM, "left_semi").select("post_text_id", *TERM), "post_text_id")
    return carrying.join(survivors, TERM[::-1] + PLACE, "left_semi").select(*PLACE, "source_name", "message_id", "post_text_id", *TERM)


def term_labels(kept: DataFrame, term_posts: DataFrame, forms: DataFrame, source_terms: DataFrame) -> DataFrame:
    """The word shown: a word's dictionary form; a phrase as spelled by the channel with most posts carrying it.

    A channel's posts with a surviving term are counted from `term_posts`, which hold each of them once. They are what `source_terms` says of
    it, but without a shuffle of the terms that did not survive.
    """
    copies = term_posts.filter("term_type = 'phrase' and source_name is not null").groupBy(*PLACE, "source_name", "post_text_id", *TERM).agg(F.count(F.lit(1)).alias("_n"))
    spelled = copies.join(forms, [*TERM[::-1], "post_text_id"]).groupBy(*PLACE, "source_name", *TERM, "term_form").agg(
        F.sum(F.col("_n") * F.col("term_uses")).alias("form_uses"))
    per_source = spelled.groupBy(*PLACE, "source_name", *TERM).agg(
        F.min_by("term_form", F.struct(-F.col("form_uses"), F.col("term_form"))).alias("source_label"))
    carrying = copies.groupBy(*PLACE, "source_name", *TERM).agg(F.sum("_n").alias("posts_with_term"))
    phrases = per_source.join(carrying, [*TERM[::-1], "source_name", *PLACE]).groupBy(*PLACE, *TERM).agg(
        F.min_by("source_label", F.struct(-F.col("posts_with_term"), F.col("source_label"))).alias("term_label"))
    words = kept.filter(F.col("term_type") == "word").select(*PLACE, *TERM, F.col("term_key").alias("term_label"))
    return phrases.unionByName(words)


def term_lists(term_posts: DataFrame, chunk: int = 10_000) -> DataFrame:
    """The exact posts behind each term as source:id keys, in parts of bounded size."""
    keyed = term_posts.withColumn("_key", F.concat_ws(":", "source_name", "message_id"))
    return chunked_list(keyed, PLACE + TERM, "_key", "post_keys", chunk)


def group_terms(kept: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinctive terms ranked inside event, group and type.

    Both shares lie in 0 … 1, so with the smoothing distinctiveness lies within ±6 and is cut into blocks there.
    """
    order = [F.desc("distinctiveness"), F.desc("posts_with_term"), F.col("term_key")]
    block = score_block(F.col("distinctiveness"), -6.0, 6.0)
    ranked = rank_in_blocks(kept, [*PLACE, "term_type"], block, order, "distinctiveness_rank")
    return ranked.join(labels, PLACE + TERM)
