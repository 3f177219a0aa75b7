"""Whole operators against plain Python: scores of trees walked row by row, thresholds, linked calls, and the pipeline's stages one after the other."""
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def words(n, seed, size=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def test_scores_walk_the_trees_row_by_row(spark):
    from newsgauge.llm.quality_rules import COUNTS, document_statistics, features, judged, train
    r = random.Random(4)
    rows = [(i, words(r.randrange(5, 90), i)) for i in range(120)] + [(200 + i, " ".join(r.choice(["%%%", "###", "$", "WORD", "12"]) for _ in range(r.randrange(21, 60)))) for i in range(80)]
    rows += [(500, None), (501, ""), (3, "a second text under the same id " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)] + [(200 + i, 0, 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    forest = train(document_statistics(docs), labels)
    got = judged(docs, labels).collect()
    assert len(got) == len(rows) and forest is not None and len({r.kept for r in got}) == 2
    for row in got:
        x, total, inner = features({c: [row[c]] for c in COUNTS})[0], forest.base, forest.split.shape[1]
        for split, at, leaf in zip(forest.split, forest.at, forest.leaf, strict=True):
            node = 0
            while node < inner:
                node = 2 * node + (2 if x[split[node]] > at[node] else 1)
            total += leaf[node - inner]
        score = 1 / (1 + np.exp(-total))
        failed = row.n_words < 20 or 100 * row.n_repeat_words > 30 * row.n_words
        assert abs(row.score - score) < 1e-12 and row.base_failed == failed and row.kept == (not failed and score >= 0.5)


def test_thresholds_are_quantiles_of_held_out_text(spark):
    from newsgauge.llm.language_model import HOLD_OUT, judged
    rows = [(i, words(40 + i % 7, i, 60 if i % 3 else 4000), ["en", "de", None, "fr"][i % 4]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 160) if i % 4 != 3], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in judged(docs, labels, quantile=0.8).collect()}
    held = {r.doc_id for r in labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(HOLD_OUT)) == 0).collect()}

    def quantile(ids):
        values = sorted(got[i].perplexity for i in ids)
        return values[int(np.ceil(0.8 * len(values))) - 1]
    for i, r in got.items():
        own = [k for k in held if got[k].lang == r.lang]
        threshold = quantile(own or held)
        assert r.threshold == pytest.approx(threshold) and r.kept == (r.perplexity <= threshold)
    assert 0 < sum(r.kept for r in got.values()) < len(got)


def linked(rows, tools):
    """What the operator promises, conversation by conversation."""
    from newsgauge.llm.tool_calls import canonical, parsed
    events = [(c, t, i, role, e) for c, t, role, text in rows for i, e in enumerate(parsed(text, tools))]
    out = []
    calls, results = {}, {}
    for c, t, i, _, e in sorted((x for x in events if x[0] is not None), key=lambda x: x[1:3]):
        if e["kind"] != "message":
            (calls if e["kind"] == "call" else results).setdefault((c, e["call_id"]), (t, i, e))
    level = {}
    for _ in calls:
        for (c, k), (_, _, e) in calls.items():
            needs = [(c, a) for a in e["after"] if (c, a) in calls]
            if all(n in level for n in needs):
                level[c, k] = max((level[n] + 1 for n in needs), default=0)
    for c, t, i, role, e in events:
        key, kind = (c, e.get("call_id")), e["kind"]
        status, at = "ok", None
        if kind == "call":
            mine = c is not None and calls[key][:2] == (t, i)
            at = level.get(key) if mine else None
            status = ("orphan" if c is None else "duplicate" if not mine else e["error"] if e["error"] else "circular" if key not in level else "ok" if key in results else "unanswered")
            answer = results[key][2]["body"] if mine and key in results else "null"
            body = f'{{"arguments":{e["body"]},"id":{canonical(e["call_id"])},"name":{canonical(e["name"])},"result":{answer}}}'
        elif kind == "result":
            status = "orphan" if c is None or key not in calls else "ok" if results[key][:2] == (t, i) else "duplicate"
            body = f'{{"content":{e["body"]},"id":{canonical(e["call_id"])}}}'
        else:
            body = f'{{"content":{e["body"]},"role":{canonical(role or "")}}}'
        out.append((c, t, i, kind, at, status, body))
    return sorted(out, key=str)


def test_linked_calls_equal_plain_python(spark):
    from newsgauge.llm.tool_calls import formatted
    r = random.Random(6)
    tools = {"f": {"text": {"type": "string", "required": True}}, "g": {"n": {"type": "integer"}}}
    rows = []
    for c in range(25):
        for t in range(r.randrange(1, 9)):
            lines = [r.choice(["hello", "é \"quoted\"", ""])]
            for _ in range(r.randrange(3)):
                args = r.choice([{"text": words(6000, c)}, {"n": 3}, {"text": 5}, {"other": 1}])             # long texts are checked and written whole
                lines.append(json.dumps({"tool_call": {"id": f"c{r.randrange(6)}", "name": r.choice("fgh"), "arguments": args, "after": [f"c{r.randrange(6)}" for _ in range(r.randrange(3))]}}))
            for _ in range(r.randrange(3)):
                lines.append(json.dumps({"tool_result": {"id": f"c{r.randrange(7)}", "content": {"z": r.randrange(9), "a": words(3000, c + t)}}}))
            rows.append((c, t, r.choice(["user", "assistant", None]), "\n".join(lines)))
    rows += [(None, 0, "user", rows[5][3]), (30, 0, None, None), (31, 0, "user", "")]
    got = formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).collect()
    assert sorted(((x.conv_id, x.turn, x.pos, x.kind, x.level, x.status, x.json) for x in got), key=str) == linked(rows, tools)
    twice = rows[:4] + rows[2:3]                                             # a repeated row repeats its events
    assert formatted(spark.createDataFrame(twice, "conv_id long, turn long, role string, text string"), tools).count() == sum(1 for _ in linked(twice, tools))


def test_run_is_its_stages_with_both_kinds_of_labels(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline as C
    from newsgauge.llm.quality_rules import judged
    r = random.Random(9)
    item = words(30, 55, 5000)
    good = [(i, words(60 + i % 40, 100 + i, 9000)) for i in range(60)]
    junk = [(100 + i, " ".join(r.choice(["%%%", "###", "$", "WORD"]) for _ in range(40))) for i in range(40)]
    passage = words(60, 77, 9000)
    shared = [(200 + i, f"{words(40, 300 + i, 9000)}\n{passage}\n{words(40, 400 + i, 9000)}") for i in range(5)]
    rows = [*good, *junk, *shared, (70, good[0][1]), (70, words(70, 901, 9000)), (80, words(50, 200, 9000) + " " + item), (90, "short"), (91, None), (92, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(100 + i, 0, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # In plain Python, but for the trees, which are held against plain Python above.
    kept = {(x.doc_id, x.n_words) for x in judged(docs, labels).collect() if x.kept}
    left = [(i, t) for i, t in rows if (i, len((t or "").split())) in kept]
    assert not any(i >= 90 and i < 200 for i, _ in left) and len(left) >= 60
    left = [(i, "\n".join(x for x in t.split("\n") if x != passage)) if i > 200 else (i, t) for i, t in left]          # the first of five copies stays
    sets = {}
    for i, t in left:
        w = t.lower().split()
        sets[i, t] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    left = [(i, t) for i, t in left if not any(j < i and near(sets[j, u], sets[i, t]) for j, u in left)]
    left = [(i, t) for i, t in left if item not in t]
    coder = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, tuple(coder.encode(t))) for i, t in left)
    got = C.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id, tuple(x.ids)) for x in got) == want and all(x.round_trip for x in got)
    assert {i for i, _ in left} >= {*range(60), 70, *range(200, 205)} - {0} and (70, rows[-5][1]) in left
