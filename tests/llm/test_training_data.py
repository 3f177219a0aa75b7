"""The training-data operators on small tables: brute force, nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, node string, score string"


def words(n, seed, size=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = words(120, 1)
    rows = [(1, base), (2, base), (3, base.replace("w7 ", "q ", 2)), (4, words(90, 2)), (5, None), (6, ""), (7, " \n\t"), (8, "one two"), (9, "ONE two"),
            (9, "ONE two"), (None, base), (10, "x " * 3000), (11, words(30_000, 3)), (12, base + " " + words(60, 9)), (13, "a b c d\ne f\n\ng")]
    return spark.createDataFrame([(i, t, "en", "s", 0, "a", "b", "c") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (11, 1, 0), (12, 1, 0), (10, 0, 0), (13, 0, None), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_groups_match_brute_force(spark, docs):
    from newsgauge.llm.near_dups import near_groups
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    group = {i: i for i, _ in rows if i is not None}
    for _ in rows:
        for i, t in rows:
            for j, u in rows:
                a, b = shingles(t), shingles(u)
                if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    got = near_groups(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(group.items())
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert near_groups(docs.limit(0)).count() == 0


def test_many_edited_copies_make_one_group_and_far_ones_do_not(spark):
    from newsgauge.llm.near_dups import near_groups
    r, base = random.Random(4), [f"v{i}" for i in range(150)]
    texts = []
    for k in range(150):
        t = list(base)
        for _ in range(r.randrange(1, 9)):
            t[r.randrange(150)] = f"n{k}-{r.randrange(10 ** 6)}"
        texts.append(" ".join(t))
    sets = [shingles(t) for t in texts]
    label = list(range(150))
    for _ in range(150):
        before = list(label)
        for i in range(150):
            for j in range(i):
                n = len(sets[i] & sets[j])
                if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                    label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    got = near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(label))


def test_quality_counts_match_brute_force(docs, labels):
    from newsgauge.llm.quality_rules import judged, kept_documents
    got = judged(docs, labels).collect()
    assert len(got) == docs.count()
    by = {}
    for r in docs.collect():
        t = r.text or ""
        w = t.encode().split()
        seen = {}
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i:i + 8]), []).append(i)
        inside = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
        lines = [x for x in t.split("\n") if x.split()]
        by.setdefault(r.doc_id, (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)))
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == by[r.doc_id] for r in got)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert kept_documents(docs, labels.limit(0)).columns == docs.columns
    assert judged(docs.limit(0), labels).count() == 0


def test_forest_keeps_its_directions():
    from newsgauge.llm.quality_rules import fit_forest
    r = np.random.default_rng(1)
    x = r.random((2000, 3))
    y = ((x[:, 0] - x[:, 1] + r.normal(0, 0.3, 2000)) > 0).astype(float)
    forest = fit_forest(x, y, [1, -1, 0])
    for j, way in ((0, 1), (1, -1)):
        at = np.repeat(r.random((50, 3)), 20, axis=0)
        at[:, j] = np.tile(np.linspace(0, 1, 20), 50)
        assert (np.diff(forest.score(at).reshape(50, 20), axis=1) * way >= -1e-12).all()
    fresh = r.random((1000, 3))
    assert ((forest.score(fresh) > 0.5) == (fresh[:, 0] > fresh[:, 1])).mean() > 0.9


def test_line_chunks_go_once_and_bytes_stay(spark, docs):
    from newsgauge.llm.line_dedup import without_repeats
    long, a = words(60, 5), "first line here\nsecond line here"
    rows = [(1, f"{long}\nown one"), (2, f"own two\n{long}\nown three"), (3, None), (4, ""), (5, f"{long}\n{long}"), (6, a), (7, a), (7, a)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, n_removed string, digest string")
    got = {r.doc_id: r for r in without_repeats(df).collect()}
    assert long in got[1].text and long not in got[2].text and got[2].text == "own two\nown three"
    assert got[3].text is None and got[4].text == "" and got[5].text == "" and got[6].text == a and got[7].text == "" and got[1].digest == "y"
    assert without_repeats(docs).count() == docs.count()
    assert without_repeats(df.limit(0)).count() == 0


def test_repeated_passages_go_whatever_stands_around_them(spark):
    from newsgauge.llm.line_dedup import without_repeats
    passage = [words(20, 300 + k, 9000) for k in range(3)]
    rows = [(1, "\n".join(["own start", *passage, "own end"]))]
    for i in range(2, 40):                                                                                   # a blank line inside changes nothing
        rows.append((i, "\n".join([f"foreign {i} before", f"and {i} more", passage[0], *[""] * (i % 2), *passage[1:], f"foreign {i} after", "", f"last {i}"])))
    short = [f"short line {k}" for k in range(3)]
    rows += [(50, "\n".join(["x50", *short, "y50"])), (51, "\n".join(["x51", passage[0], "alone", passage[1], passage[0]]))]
    rows += [(60, "\n".join([*passage, "z60", *passage])), (60, "\n".join([*passage, "z60", *passage])), (None, "\n".join(["n", *passage, "n2"]))]
    got = {r.doc_id: r for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    by = dict(rows)
    assert got[None].text == by[None]                                                                       # null ids come first
    assert got[1].text == "own start\nown end"
    for i in range(2, 40):
        assert got[i].text == "\n".join([f"foreign {i} before", f"and {i} more", f"foreign {i} after", "", f"last {i}"]), i
    assert got[50].text == by[50] and got[51].text == by[51] and got[60].text == "z60"
    assert got[1].n_removed >= 1 and got[50].n_removed == 0


def test_lines_go_only_out_of_whole_copies_of_one_stretch(spark):
    """Two repeats that meet in a third text are no passage of fifty words; neither are lines that stand apart."""
    from newsgauge.llm.line_dedup import without_repeats
    a, b, c = (words(20, 700 + k, 9000) for k in range(3))
    rows = [(1, f"{a}\n{b}\nown1"), (2, f"{b}\n{c}\nown2"), (3, f"{a}\n{b}\n{c}"), (4, f"{a}\nbetween\n{b}\nbetween too\n{c}"), (5, f"x\n{a}\n{b}\n\n{c}\ny")]
    got = {r.doc_id: r.text for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [dict(rows)[i] for i in (1, 2, 3, 4)] and got[5] == "x\ny"


def test_hot_stretches_are_salted_and_names_do_not_clash(spark, monkeypatch):
    import newsgauge.llm.line_dedup as L
    monkeypatch.setattr(L, "SALTED", 3)
    a, b = words(30, 801, 9000), words(30, 802, 9000)
    rows = [(i, f"head {i}\n{a}\n{b}\ntail {i}", i, "k", "g", [1]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_key` long, gone string, `row` string, ends array<int>")
    got = {r.doc_id: r for r in L.without_repeats(docs).collect()}
    assert got[0].text == rows[0][1] and all(got[i].text == f"head {i}\ntail {i}" for i in range(1, 60))
    assert all((got[i]["_key"], got[i].gone, got[i].row, got[i].ends) == (i, "k", "g", [1]) for i in got)


def test_line_dedup_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from newsgauge.llm.line_dedup import CHECK_SQL, without_repeats
    folder = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}'")
    got = without_repeats(spark.read.parquet(folder)).select("doc_id", "text", "n_chunks", "n_removed").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(CHECK_SQL).fetchall())


def test_every_repeated_passage_of_fifty_words_goes(spark):
    """Passages that many texts share, put into other lines at random: no run of lines with fifty words that stood before is left."""
    from newsgauge.llm.line_dedup import without_repeats
    r = random.Random(21)
    lines = [words(r.randrange(3, 30), 900 + k, 9000) for k in range(30)]
    rows = []
    for i in range(60):
        a = r.randrange(24)
        rows.append((i, "\n".join([f"own {i} {words(5, i)}", *lines[a:a + r.randrange(1, 7)], f"more {i}", *[""] * r.randrange(2), f"alone {r.randrange(30)}", f"end {i}"])))
    left = {x.doc_id: x.text.split("\n") for x in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen: set[tuple] = set()
    for i, text in rows:
        rich = [x for x in text.split("\n") if x]
        runs = {tuple(rich[a:z]) for a in range(len(rich)) for z in range(a + 2, len(rich) + 1) if sum(len(x.split()) for x in rich[a:z]) >= 50}
        gone = {x for run in runs & seen for x in run}
        assert not gone & set(left[i]), i
        assert all(x in left[i] for x in rich if x.startswith(("own", "more", "end")))
        seen |= runs


def test_leaks_find_exact_and_edited_copies(spark, docs):
    from newsgauge.llm.decontaminate import leaks
    item = words(40, 77, 5000)
    edited = item.split()
    edited[5], edited[20] = "other", "words"
    del edited[30]
    rows = [(1, "before " + item + " after"), (2, words(200, 8) + " " + " ".join(edited)), (3, words(300, 6)), (4, None), (5, item.upper())]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id int")
    tests = spark.createDataFrame([(9, item, 0), (10, None, 0), (11, "too short", 0), (12, "", 0)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r for r in leaks(df, tests, block_chars=100).collect()}
    assert set(got) == {(1, 9), (2, 9), (5, 9)} and got[1, 9].score == 1.0 and 0.6 <= got[2, 9].score < 1
    assert (got[1, 9].first_word, got[1, 9].last_word) == (1, 41)
    assert leaks(df, tests.limit(0)).count() == 0 and leaks(df.limit(0), tests).count() == 0


def test_leaks_equal_alignment_of_everything_when_all_words_are_common(spark):
    from newsgauge.llm.decontaminate import align, hashed, leaks
    r = random.Random(3)
    items = [(k, words(n, 900 + k, 3000)) for k, n in enumerate([15, 15, 12, 8, 8, 6, 25, 30])]
    rows = [(i, words(12, 7000 + i) + " " + items[i % len(items)][1] + " end") for i in range(200)]         # every trigram occurs 25 times
    for i in range(200, 600):
        w = items[i % len(items)][1].split()
        for _ in range(r.randrange(1, 2 + len(w) // 3)):
            at = r.randrange(len(w))
            w[at:at + 1] = r.choice([["new"], [w[at], "put"], [], ["put", w[at]]])
        rows.append((i, f"some {i} words " + " ".join(w) + f" after {i}"))
    w = items[3][1].split()
    rows.append((600, " ".join([*w[:2], "put", *w[2:4], "put", *w[4:6], "put", *w[6:]])))                    # no three words in a row
    got = {(x.doc_id, x.item_id): round(x.score, 9) for x in leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    coded = {k: hashed([t.encode()])[0] for k, t in items}
    want = {}
    for i, t in rows:
        text = hashed([t.encode()])[0]
        for k, item in coded.items():
            score = align(item, text)[0] / (2 * len(item))
            if score >= 0.6:
                want[i, k] = round(score, 9)
    assert got == want and (600, 3) in want


def test_seeds_without_enough_of_them_together(spark):
    from newsgauge.llm.decontaminate import Block, leaks
    item = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "x w0 w1 y z"), (2, "w0 w1 " * 30), (3, item)], "doc_id long, text string")
    assert [(r.doc_id, r.score) for r in leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()] == [(3, 1.0)]
    block = Block([(7, item)])
    counts = np.zeros(len(block.kinds), np.int64)
    counts[:5] = 9                                                           # five common pairs; 39 pairs, of which an alignment of 0.6 leaves 7 whole
    block.choose(counts, 0.6)
    assert len(block.seed_hash) == 33 and not set(block.seed_hash) & set(block.kinds[:5])


def test_short_items_are_matched_whole(spark):
    from newsgauge.llm.decontaminate import leaks
    docs = spark.createDataFrame([(1, "x the quick Fox y the quick fox"), (2, "the quick brown fox"), (3, "fox"), (4, "the quick"), (5, "fox runs")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "The quick fox"), (2, "fox"), (3, "a b c d e"), (4, " ")], "item_id long, text string")
    assert {tuple(r) for r in leaks(docs, items).drop("text_id").collect()} == {(1, 1, 1.0, 1, 4), (1, 2, 1.0, 3, 4), (2, 2, 1.0, 3, 4), (3, 2, 1.0, 0, 1), (5, 2, 1.0, 0, 1)}


def test_language_model_prefers_trusted_text(spark, docs, labels):
    from newsgauge.llm.language_model import judged
    clean = [(i, words(80, i), "en") for i in range(100)]
    odd = [(200, "%%% ### $$$ " * 40, "en"), (201, None, "en"), (202, "", None)]
    got = {r.doc_id: r for r in judged(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string"),
                                       spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int"), heavy=50).collect()}
    assert len(got) == 103 and not got[200].kept and sum(got[i].kept for i in range(100)) >= 95
    assert got[200].perplexity > 5 * max(got[i].perplexity for i in range(100))
    assert all(r.kept for r in judged(docs, labels.limit(0)).collect())
    assert judged(docs.limit(0), labels).count() == 0


def brute_perplexities(train, texts):
    """Word trigrams, interpolated modified Kneser-Ney, with dictionaries."""
    pad = lambda t: ["<", "<", *(t or "").split(), ">"]
    c = {3: {}, 2: {}, 1: {}}
    for w in map(pad, train):
        for i in range(2, len(w)):
            c[3][tuple(w[i - 2:i + 1])] = c[3].get(tuple(w[i - 2:i + 1]), 0) + 1
    raw = dict(c[3])
    for m in (2, 1):
        low = {}
        for g, n in raw.items():
            low[g[1:]] = low.get(g[1:], 0) + n
        for g in c[m + 1]:
            c[m][g[1:]] = c[m].get(g[1:], 0) + (raw[g] if g[0] == "<" else 1)
        raw = low
    cuts, about = {}, {}
    for m in c:
        n = [sum(v == i for v in c[m].values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else None
        cuts[m] = [max(min(i - (i + 1) * y * n[i + 1] / n[i], i - 0.05), 0.05) if y is not None and n[i] and n[i + 1] else 0.5 for i in (1, 2, 3)]
        for g, v in c[m].items():
            total, left = about.get(g[:-1], (0, 0))
            about[g[:-1]] = total + v, left + cuts[m][min(v, 3) - 1]

    def p(g):
        if not g:
            return 1 / (len(c[1]) + 1)
        below = p(g[1:])
        if g[:-1] not in about:
            return below
        total, left = about[g[:-1]]
        v = c[len(g)].get(g, 0)
        return (v - cuts[len(g)][min(v, 3) - 1] if v else 0) / total + left / total * below
    out = []
    for w in map(pad, texts):
        out.append(np.exp(-np.mean([np.log(p(tuple(w[i - 2:i + 1]))) for i in range(2, len(w))])))
    return out


@pytest.mark.parametrize("heavy", [30, 10 ** 6])
def test_language_model_equals_word_trigrams_by_brute_force(spark, heavy):
    from newsgauge.llm.language_model import perplexities
    texts = [words(40, i, 25) for i in range(30)] + ["w1 w2 w3", "w3 w2 w1", "new w1 w2", "", None, "w1", "w1 w2 w3 " * 20]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in perplexities(docs, spark.createDataFrame([(i,) for i in range(20)], "doc_id long"), heavy).collect()}
    want = brute_perplexities(texts[:20], texts)
    assert [got[i].places for i in range(len(texts))] == [len((t or "").split()) + 1 for t in texts]
    assert np.allclose([got[i].perplexity for i in range(len(texts))], want, rtol=1e-9)


def test_wavelet_and_token_files(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from newsgauge.llm.wavelet import Wavelet, token_table
    x = np.random.default_rng(2).integers(0, 90, 3001)
    w = Wavelet.from_bytes(Wavelet.build(x, 7).to_bytes([None, 3], np.array([10, 3001])))[0]
    assert (w.decode() == x).all() and (w.access(np.arange(3001)) == x).all() and (w.occurrences(5) == np.flatnonzero(x == 5)).all() and w.count(5, 9, 700) == (x[9:700] == 5).sum()
    t, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    got = sorted(token_table(docs.filter("doc_id is not null and doc_id <> 9"), P.path("byte_bpe_50k.json")).collect(), key=lambda r: r.doc_id)
    for r, d in zip(got, sorted(docs.filter("doc_id is not null and doc_id <> 9").collect(), key=lambda r: r.doc_id), strict=True):
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_table(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_planes_are_parted_by_places_and_not_by_masks():
    import time

    from newsgauge.llm.wavelet import STRIP, Wavelet
    x = np.random.default_rng(4).integers(0, 1 << 16, 20 * STRIP + 77).astype(np.uint16)

    def by_masks():
        now, planes = x, []
        for k in range(15, -1, -1):
            planes.append((now & np.uint16(1 << k)) != 0)
            now = np.concatenate((now[~planes[-1]], now[planes[-1]]))
        return planes

    def least(run):
        took = []
        for _ in range(3):
            start = time.process_time()
            got = run()
            took.append(time.process_time() - start)
        return got, min(took)
    (planes, slow), (w, quick) = least(by_masks), least(lambda: Wavelet.build(x, 16))
    decoded, back = least(w.decode)
    assert all((w.bits(k) == planes[k]).all() for k in range(16)) and (decoded == x).all()
    assert quick < 0.7 * slow and back < 0.7 * slow


def test_added_tokens_get_the_ids_of_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from newsgauge.llm.wavelet import token_table
    texts = ["one<|endoftext|> two", "<|endoftext|>", "a  <|endoftext|>\nb c", "x <|endoftext|><|endoftext|> y", "plain text", "<|endoftext | >", "of <|endoftext|>"]
    t, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    got = sorted(token_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect(), key=lambda r: r.doc_id)
    for r, text in zip(got, texts, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        at += len(ids)


def test_pieces_equal_the_library(spark, docs):
    P, sp = pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
    from newsgauge.llm.pieces import encoded
    m = sp.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in encoded(docs, P.path("piece_bpe_32k.model")).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert list(r.ids) == m.encode(r.text or "") and r.round_trip
    assert encoded(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_url_parts_rules_and_mined_tokens(spark):
    from newsgauge.llm.url_filter import judged
    urls = ["http://A.Example.ORG/es/1", "http://example.org/en/12", "x://a.org", "http://b.com/fr/", "nothing", None, "", "http://notorg/", "http://a.net/bad/1?q=2#f"]
    urls += [f"http://h{i % 5}.net/{'bad' if i < 12 else 'good'}/{i}" for i in range(40)]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(i + 9, 0 if i < 12 else 1) for i in range(40)], "doc_id long, quality int")
    got = {r.page_id: r for r in judged(pages, labels).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(8)] == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("a.org", "", None, "allow"),
        ("b.com", "/fr/", "com/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("notorg", "/", None, "allow")]
    assert got[8].verdict == "block" and got[8].path == "/bad/1" and got[20].verdict == "block" and got[30].verdict == "allow"
    assert {r.verdict for r in judged(pages, labels.limit(0)).collect()} == {"allow", "block"}
    assert judged(pages.limit(0), labels).count() == 0


def test_url_rules_of_any_length(spark):
    """Pages that only four tokens together tell apart from good ones."""
    from itertools import combinations
    from newsgauge.llm.url_filter import judged, mined_rules, tokens
    good = [c for n in (2, 3) for c in combinations("abcd", n)]
    urls = [f"http://x.net/{'/'.join(c)}/" for c in good for _ in range(6)] + ["http://x.net/a/b/c/d/"] * 20 + ["http://x.net/zz/"] * 60
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    bad = {i for i, u in enumerate(urls) if u.endswith("a/b/c/d/")}
    labels = spark.createDataFrame([(i, 0 if i in bad else 1) for i in range(len(urls))], "doc_id long, quality int")
    got = {r.page_id: (r.verdict, r.confidence) for r in judged(pages, labels).collect()}
    baskets = [frozenset(["h:x", "h:net", *[f"p:{x}" for x in u.split("/")[3:] if x]]) for u in urls]
    rules = {}
    for k in range(1, 7):                                                    # every combination there is
        for s in {frozenset(c) for b in baskets for c in combinations(sorted(b), k)}:
            n, hit = sum(s <= b for b in baskets), sum(s <= b for i, b in enumerate(baskets) if i in bad)
            if hit >= 0.002 * len(urls) and hit / n >= 0.5 and hit / n >= 2 * len(bad) / len(urls):
                rules[s] = hit / n
    want = {i: max((c for s, c in rules.items() if s <= b), default=None) for i, b in enumerate(baskets)}
    assert got == {i: ("block" if c else "allow", c) for i, c in want.items()} and {len(s) for s in rules} >= {4, 5, 6}
    from newsgauge.llm.url_filter import host, path
    parts = pages.join(labels, pages.page_id == labels.doc_id).withColumn("tokens", tokens(F.col("url"), host(F.col("url")), path(F.col("url"))))
    kept = {frozenset(r["items"]): r.confidence for r in mined_rules(parts, F.col("quality") == 0).collect()}
    assert kept == {s: c for s, c in rules.items() if not any(t < s and d >= c for t, d in rules.items())}


def test_shards_are_even_and_few_keys_move(spark):
    from newsgauge.llm.sharding import fill, placed, write_shards
    table = fill({f"s{i}": 2 if i == 0 else 1 for i in range(9)}, 1009)
    n = {s: table.count(s) for s in set(table)}
    assert abs(n["s0"] - 2 * n["s1"]) <= 2 and max(n[s] for s in n if s != "s0") - min(n.values()) <= 1
    less = fill({f"s{i}": 2 if i == 0 else 1 for i in range(8)}, 1009)
    assert sum(a != b for a, b in zip(table, less, strict=True) if a != "s8") < 0.1 * 1009
    df = spark.range(1000).select(F.when(F.col("id") > 9, F.col("id")).alias("k"), F.lit(1).alias("slot"))
    got = placed(df, ["k"], {"a": 1, "b": 1}, 101)
    assert got.count() == 1000 and got.filter("k is null").select("shard").distinct().count() == 1
    from newsgauge.session import run_dir
    path, two = run_dir(spark, "shards"), {"a": 1, "b": 1}
    files = write_shards(df.withColumn("shard", F.lit("mine")), ["k"], two, path, 101)
    assert files.count() == 1000 and spark.read.parquet(path).count() == 1000
    at = fill(two, 101)
    assert all(r.shard == at[r.slot] for r in files.collect())               # the table, row by row
    again = placed(df.union(df), ["k"], two, 101).collect()
    assert len(again) == 2000 and len({(r.k, r.slot, r.shard) for r in again}) == 991                       # ten null keys alike
    assert write_shards(df.limit(0), ["k"], two, run_dir(spark, "shards"), 101).count() == 0
    with pytest.raises(ValueError):
        fill({"a": 1}, 100)


def test_tool_calls_are_linked_ordered_and_checked(spark):
    from newsgauge.llm.tool_calls import formatted
    call = lambda i, name="f", args=None, after=(): json.dumps({"tool_call": {"id": i, "name": name, "arguments": {"b": 1} if args is None else args, "after": list(after)}})
    answer = lambda i: json.dumps({"tool_result": {"id": i, "content": {"z": 1, "a": 2}}})
    rows = [(1, 0, "user", "hi\n" + call("x", after=["y"]) + "\n" + call("y")), (1, 1, "tool", answer("x") + "\n" + answer("x") + "\n" + answer("q")), (1, 2, "user", call("x")),
            (1, 3, "user", call("p", after=["r"]) + "\n" + call("r", after=["p"])), (2, 0, "user", call("x", args={"b": True})), (2, 1, None, None), (None, 0, "user", call("x")),
            (2, 2, "user", '{"tool_call": [}'), (3, 0, "user", call("n", name="none"))]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, kind string")
    got = formatted(df, {"f": {"b": {"type": "integer", "required": True}}}).collect()
    at = {(r.conv_id, r.turn, r.pos): r for r in got}
    assert (at[1, 0, 1].status, at[1, 0, 1].level) == ("ok", 1) and (at[1, 0, 2].status, at[1, 0, 2].level) == ("unanswered", 0)
    assert at[1, 0, 1].json == '{"arguments":{"b":1},"id":"x","name":"f","result":{"a":2,"z":1}}'
    assert [at[1, 1, i].status for i in (1, 2, 3)] == ["ok", "duplicate", "orphan"] and at[1, 2, 1].status == "duplicate"
    assert at[1, 3, 1].status == at[1, 3, 2].status == "circular" and at[2, 0, 1].status == "b is no integer" and at[3, 0, 1].status == "unknown tool"
    assert at[2, 1, 0].json == '{"content":"","role":""}' and at[2, 2, 0].kind == "message" and at[None, 0, 1].status == "orphan"
    assert formatted(df.limit(0), {}).count() == 0


def test_call_levels_equal_brute_force(spark):
    from newsgauge.llm.tool_calls import call_levels
    r = random.Random(8)
    after = {(1, f"c{i}"): [f"c{i - 1}"] for i in range(60)}                                              # a deep chain
    after |= {(2, f"c{i}"): [f"c{(i + 1) % 7}"] for i in range(7)} | {(2, "behind"): ["c3", "free"], (2, "free"): [], (2, "own"): ["own"]}
    after |= {(3, f"c{i}"): sorted({f"c{r.randrange(max(i - 6, 0), i)}" for _ in range(r.randrange(1, 4))}) if i else [] for i in range(80)}
    after |= {(4, f"c{i}"): sorted({f"c{r.randrange(50)}" for _ in range(r.randrange(3))}) for i in range(40)}        # circles, and needs without a call
    after |= {(5, f"c{i}"): [f"c{j}" for j in (i - 1, i + 1)] for i in range(5)}
    level = {}
    while True:
        fresh = {k: 1 + max((level[k[0], a] for a in v if (k[0], a) in after), default=-1) for k, v in after.items()
                 if k not in level and all((k[0], a) not in after or (k[0], a) in level for a in v)}
        if not fresh:
            break
        level |= fresh
    calls = spark.createDataFrame([(*k, v) for k, v in after.items()], "conv_id long, call_id string, after array<string>")
    assert {(x.conv_id, x.call_id): x.level for x in call_levels(calls).collect()} == {k: level.get(k) for k in after}
    assert call_levels(calls.limit(0)).count() == 0


def test_pipeline_keeps_columns_and_decides(spark, tmp_path, docs, labels):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as C
    item = words(30, 55, 5000)
    more = [(50 + i, words(100, 100 + i), "en", "s", 0) for i in range(20)] + [(90, words(50, 200) + " " + item, "en", "s", 0)]
    d = docs.filter("doc_id is not null").select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels.filter("quality = 1").write.parquet(f"{tmp_path}/labels.parquet")          # one kind only: no trees, the base rules decide
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == d.columns, name
    got = {r.doc_id for r in C.run(spark, str(tmp_path)).collect()}
    assert set(range(50, 70)) <= got and 90 not in got and not got & {5, 6, 7, 8, 9, 10} and len(got & {1, 2, 3}) == 1


def test_pipeline_keeps_other_texts_of_a_repeated_id(spark, tmp_path):
    """A near copy and a leak go, a different text under the same id stays."""
    import corpus_pipeline as C
    base, other, item = words(80, 401, 9000), words(80, 402, 9000), words(30, 403, 9000)
    rows = [(1, base), (9, base), (9, other), (9, words(60, 404, 9000) + " " + item), (None, base)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    one = C.near_dedup(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id or 0, r.text) for r in one.collect())) == sorted([(0, base), (1, base), (9, other), (9, rows[3][1])])
    assert sorted(((r.doc_id or 0, r.text) for r in C.decontamination(spark, one, str(tmp_path)).collect())) == sorted([(0, base), (1, base), (9, other)])
