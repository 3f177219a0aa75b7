"""Line dedup over content-defined chunks of lines, in DataFrame functions only.

A text's lines are hashed; a rolling hash over each line and the one before decides whether a chunk ends there, so
an inserted line moves no boundary but its own. A line of fifty words or more is a chunk of its own. A chunk of two
lines with words or more, or one such long line, that occurs again anywhere is removed, all but its first copy (smallest
doc_id, then place).

Chunks miss a passage whose ends they do not share. So for each line with words the shortest stretch of two such lines or more with fifty words that
starts there is looked up too, and the one that ends there. A passage of fifty words or more that stands somewhere before is covered by
such stretches, and each of them is a copy of one earlier stretch; lines without words count neither for nor against it.

Stretches are found by a digest first and then by their bytes, so that no collision removes a line. Whatever is removed stands at an earlier
place, so of every line one copy is left. Lines are hashed and their words counted once; later steps know stretches by their lines' numbers.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.session import cut_point

LONG_WORDS = 50
ENDS_BELOW = "4"           # a chunk ends where the rolling hash's first hex digit is below this: one line in four
NEAR = 8                   # lines that are summed up first; few stretches need more
SALTED = 500               # copies of a stretch that meet its first copy in one task
BLANKS, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
CHUNK, STRETCH = 0, 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once for each row, however often later expressions name it: a one-element explode is not merged into them."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _words(line: Column) -> Column:
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, BLANKS + "+")))


def _reach(lines: Column, words: int) -> Column:
    """How many of these lines from the first on make a stretch: two or more, and `words` words; 0 if they do not."""
    def over(part: Column) -> Column:
        add = lambda acc, x: F.when((acc["w"] >= words) & (acc["n"] >= 2), acc).otherwise(F.struct((acc["w"] + x["w"]).alias("w"), (acc["n"] + 1).alias("n")))
        full = lambda acc: F.when((acc["w"] >= words) & (acc["n"] >= 2), acc["n"]).otherwise(0)
        return F.aggregate(part, F.struct(F.lit(0).alias("w"), F.lit(0).alias("n")), add, full)
    near = over(F.slice(lines, 1, NEAR))
    return F.when(near > 0, near).otherwise(over(lines))


def stretches(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, key (a hash of the text), ends (the last line of each chunk), found: kind, first and last line and digest of each stretch that
    goes if it is a later copy."""
    d = once(docs.select("doc_id", F.xxhash64("text").alias("key"), "text"), "lines", lines_of(F.col("text")))
    d = once(d, "facts", F.transform("lines", lambda x: F.struct(F.md5(x).alias("h"), _words(x).alias("w")))).select("doc_id", "key", "facts")
    facts, n = F.col("facts"), F.size("facts")

    def ends(i: Column) -> Column:
        before = F.when(i > 0, F.get(facts, i - 1)["h"]).otherwise(F.lit(""))
        alone = (F.get(facts, i)["w"] >= long_words) | F.coalesce(F.get(facts, i + 1)["w"] >= long_words, F.lit(False))
        return (i == n - 1) | alone | (F.substring(F.md5(F.concat(before, F.get(facts, i)["h"])), 1, 1) < ENDS_BELOW)
    d = once(d, "ends", F.filter(F.sequence(F.lit(0), n - 1), ends))
    d = once(d, "rich", F.filter(F.transform(facts, lambda f, i: F.struct(i.alias("i"), f["h"].alias("h"), f["w"].alias("w"))), lambda x: x["w"] > 0))
    start = lambda i: F.when(i > 0, F.get(F.col("ends"), i - 1) + 1).otherwise(F.lit(0))

    def chunk(e: Column, i: Column) -> Column:
        mine = F.slice(facts, start(i) + 1, e - start(i) + 1)
        removable = (F.size(F.filter(mine, lambda f: f["w"] > 0)) >= 2) | ((e == start(i)) & (F.get(facts, e)["w"] >= long_words))
        return F.when(removable, F.struct(F.lit(CHUNK).alias("kind"), start(i).alias("a"), e.alias("z"), F.xxhash64(F.lit(CHUNK), F.transform(mine, lambda f: f["h"])).alias("digest")))
    rich, m = F.col("rich"), F.size("rich")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda k: F.array(     # places in `rich`, from 1 on
        F.struct(k.alias("a"), (k + _reach(F.slice(rich, k, F.least(m - k + 1, F.lit(long_words))), long_words) - 1).alias("z")),
        F.struct((k - _reach(F.reverse(F.slice(rich, F.greatest(k - long_words + 1, F.lit(1)), F.least(k, F.lit(long_words)))), long_words) + 1).alias("a"), k.alias("z")))))
    spans = F.when(m > 1, F.array_distinct(F.filter(spans, lambda s: s["z"] > s["a"])))

    def stretch(s: Column) -> Column:
        mine = F.slice(rich, s["a"], s["z"] - s["a"] + 1)
        return F.struct(F.lit(STRETCH).alias("kind"), F.get(rich, s["a"] - 1)["i"].alias("a"), F.get(rich, s["z"] - 1)["i"].alias("z"), F.xxhash64(F.lit(STRETCH), F.transform(mine, lambda f: f["h"])).alias("digest"))
    chunks = F.filter(F.transform("ends", chunk), lambda x: x.isNotNull())
    return d.select("doc_id", "key", "ends", F.concat(chunks, F.coalesce(F.transform(spans, stretch), F.slice(chunks, 1, 0))).alias("found"))


def later_copies(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, key, gone): first and last line of the parts of each text that go, none of which touch. Only texts that lose lines are returned.

    Digests find what may be a copy; only those texts are fetched, and compared byte by byte.
    """
    rows = table.select("doc_id", "key", F.explode("found").alias("x")).select("doc_id", "key", "x.*")
    again = cut_point(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    salts = F.ceil(F.col("n") / SALTED).cast("int")
    copies = rows.join(again.hint("merge"), "digest").withColumn("salts", salts)                      # digests and ids have no bound: never sent to every task
    wanted = cut_point(copies.groupBy("doc_id", "key").agg(F.collect_list(F.struct("kind", "a", "z", "digest", "salts")).alias("found")), "wanted")
    wanted = wanted.select(F.col("doc_id").alias("id"), F.col("key").alias("text_key"), "found")
    d = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")            # a repeated row gives its stretches again, at the same place
    d = d.join(wanted.hint("merge"), d["doc_id"].eqNullSafe(wanted["id"]) & (d["key"] == wanted["text_key"])).drop("id", "text_key")
    d = once(d, "lines", lines_of(F.col("text"))).select("doc_id", "key", "lines", F.explode("found").alias("x"))
    mine = F.slice("lines", F.col("x.a") + 1, F.col("x.z") - F.col("x.a") + 1)
    text = F.array_join(F.when(F.col("x.kind") == CHUNK, mine).otherwise(F.filter(mine, lambda x: x.rlike(WORD))), "\n")
    found = cut_point(d.select("doc_id", "key", "x.*", text.alias("part")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "key", "a"), "salts").cast("int")), "copies")
    place = F.struct("doc_id", "key", "a", "z")
    first = found.groupBy("kind", "digest", "part").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.max("salts").alias("salts")).filter("n > 1")
    first = first.select("kind", "digest", "part", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    later = found.join(first.hint("merge"), ["kind", "digest", "part", "salt"]).filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "key", "a", "z")
    own = Window.partitionBy("doc_id", "key").orderBy("a", "z")               # inside one text
    fresh = F.coalesce(F.max("z").over(own.rowsBetween(Window.unboundedPreceding, -1)) + 1 < F.col("a"), F.lit(True))
    parts = later.withColumn("fresh", fresh).withColumn("part", F.count_if("fresh").over(own)).groupBy("doc_id", "key", "part").agg(F.min("a").alias("a"), F.max("z").alias("z"))
    return parts.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("a", "z"))).alias("gone"))


def without_repeats(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """docs with `text` rid of repeated chunks and stretches of lines, and n_chunks and n_removed (chunks that lost lines).

    Null texts stay null and empty texts empty; a text of repeated lines only becomes empty. Rows that repeat an id and a text
    count as one document and are treated alike, as are rows without an id. Other columns stay as they are, whatever their names; columns named like the two counts are replaced.
    """
    table = cut_point(stretches(docs, long_words), "stretches")
    cut = cut_point(later_copies(docs, table), "gone")
    known = table.select("doc_id", "key", "ends").dropDuplicates(["doc_id", "key"])
    same = known["doc_id"].eqNullSafe(cut["doc_id"]) & (known["key"] == cut["key"])
    known = known.join(cut.hint("merge"), same, "left").select(known["doc_id"].alias("id"), known["key"].alias("text_key"), "ends", "gone")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("key"))       # one column holds what is not ours
    d = d.join(known.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("text_key")), "left").select("row", "ends", "gone")
    lost = lambda a, z: F.exists("gone", lambda g: (g["a"] <= z) & (a <= g["z"]))
    left = F.array_join(F.filter(lines_of(F.col("row.text")), lambda x, i: ~lost(i, i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left)
    chunk = lambda e, i: lost(F.when(i > 0, F.get(F.col("ends"), i - 1) + 1).otherwise(F.lit(0)), e)
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size(F.filter("ends", chunk)))
    new = F.struct(text.alias("text"), F.size("ends").cast("long").alias("n_chunks"), n_removed.cast("long").alias("n_removed"))
    d = d.select("row", new.alias("new"))
    kept = [F.col("new.text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_chunks", "n_removed")]
    return d.select(*kept, "new.n_chunks", "new.n_removed")


# The same rows; digests are left out, as the bytes decide.
CHECK_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, md5(line) AS h FROM l),
e AS (SELECT *, CASE WHEN lead(i) OVER w IS NULL OR words >= 50 OR coalesce(lead(words) OVER w >= 50, false)
  OR substr(md5(coalesce(lag(h) OVER w, '') || h), 1, 1) < '4' THEN 1 ELSE 0 END AS stop FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, coalesce(sum(stop) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM e),
c AS (SELECT doc_id, min(i) AS a, max(i) AS z, string_agg(line, chr(10) ORDER BY i) AS part, count(*) FILTER (WHERE words > 0) AS rich, count(*) AS lines, max(words) AS most FROM n GROUP BY doc_id, pos),
r AS (SELECT *, row_number() OVER w AS k, sum(words) OVER w AS total FROM f WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
d AS (SELECT doc_id, list(line ORDER BY k) AS lines FROM r GROUP BY doc_id),
s AS (SELECT a.doc_id, a.i AS a, b.i AS z, array_to_string(d.lines[a.k:b.k], chr(10)) AS part FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k + 1 AND a.k + 49 JOIN d ON d.doc_id = a.doc_id
  WHERE b.total - a.total + a.words >= 50 AND (b.k = a.k + 1 OR b.total - a.total + a.words - b.words < 50 OR b.total - a.total < 50)),
p AS (SELECT 0 AS kind, doc_id, a, z, part FROM c WHERE rich >= 2 OR (lines = 1 AND most >= 50) UNION ALL SELECT 1, doc_id, a, z, part FROM s),
g AS (SELECT doc_id, a, z FROM (SELECT *, row_number() OVER (PARTITION BY kind, part ORDER BY doc_id, a, z) AS copy FROM p) WHERE copy > 1),
x AS (SELECT DISTINCT doc_id, unnest(generate_series(a, z)) AS i FROM g),
t AS (SELECT n.doc_id, string_agg(line, chr(10) ORDER BY n.i) FILTER (WHERE x.i IS NULL) AS text, count(DISTINCT pos) AS n_chunks, count(DISTINCT pos) FILTER (WHERE x.i IS NOT NULL) AS n_removed
  FROM n LEFT JOIN x ON x.doc_id = n.doc_id AND x.i = n.i GROUP BY n.doc_id)
SELECT doc_id, coalesce(text, '') AS text, CAST(n_chunks AS BIGINT) AS n_chunks, CAST(n_removed AS BIGINT) AS n_removed FROM t
UNION ALL SELECT doc_id, NULL, 1, 0 FROM documents WHERE text IS NULL
"""
