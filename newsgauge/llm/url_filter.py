"""URL filters: fixed host rules first, then token combinations that FP-growth finds in the labels.

A URL is a basket of host labels, path segments (digits as #) and query keys. Labelled baskets, with the label as one more
item, go through Spark's FP-growth; rules of any length that lead to the label are kept by support, confidence and lift. Only those
go that a part of them implies with no less confidence: they change no verdict and no confidence. Rules are
indexed under their rarest token, and each distinct basket is looked up once, however many URLs share it.
"""
from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.session import cut_point

BAD = "=block"
SUPPORT, CONFIDENCE, LIFT = 0.002, 0.5, 2.0
# Fixed values: (host, path, verdict); the longest rule that fits wins.
HOST_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: Column, host: Column, path: Column) -> Column:
    named = lambda parts, kind: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    query = F.split_part(F.split_part(F.coalesce(url, F.lit("")), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(2))
    keys = F.transform(F.split(query, "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    return F.array_distinct(F.concat(named(F.split(host, r"\."), "h:"), named(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), "p:"), named(keys, "q:")))


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), null where none does. A rule fits its host and all hosts below it."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def mined_rules(baskets: DataFrame, bad: Column, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """(items, confidence, probe): token combinations that lead to the bad label; probe is the rarest of them."""
    marked = baskets.select(F.when(bad, F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(marked)
    leads = (F.col("consequent") == F.array(F.lit(BAD))) & (F.col("lift") >= lift)
    rules = model.associationRules.filter(leads).select(F.array_sort("antecedent").alias("items"), "confidence")
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    probes = rules.select("items", "confidence", F.explode("items").alias("token")).join(single, "token")
    rules = cut_point(probes.groupBy("items", "confidence").agg(F.min(F.struct("freq", "token")).alias("rare")).select(
        "items", "confidence", F.col("rare.token").alias("probe")), "url-rules")
    part = rules.select(F.col("items").alias("part"), F.col("confidence").alias("part_confidence"), "probe")
    inside = (F.size("part") < F.size("items")) & (F.col("part_confidence") >= F.col("confidence")) & (F.size(F.array_intersect("items", "part")) == F.size("part"))
    implied = rules.select("items", "confidence", F.explode("items").alias("probe")).join(part, "probe").filter(inside).select("items").distinct()
    return cut_point(rules.join(implied, "items", "left_anti"), "url-rules")


def judged(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of the best mined rule that fits) of every row of pages (page_id, url).

    A label belongs to the page with its id; quality 0 is bad. Null urls have empty parts and no token, so they are allowed, as
    is everything where there are no labels. Rows stay as many as they were; other columns are ignored.
    """
    parts = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    parts = parts.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path"))).drop("url")
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.min("quality").alias("quality"))
    rules = mined_rules(parts.join(known, "page_id"), F.col("quality") == 0)
    key = F.md5(F.concat_ws("\n", "tokens"))
    kinds = parts.groupBy(key.alias("basket")).agg(F.first("tokens").alias("tokens"))
    met = kinds.select("basket", "tokens", F.explode("tokens").alias("probe")).join(rules, "probe").filter(F.size(F.array_intersect("tokens", "items")) == F.size("items"))
    best = cut_point(met.groupBy("basket").agg(F.max("confidence").alias("confidence")), "baskets")
    rule, verdict = host_rule(F.col("host"), F.col("path"))
    out = parts.withColumn("basket", key).join(best, "basket", "left")
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "confidence")


CHECK_SQL = rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
t AS (SELECT *, list_distinct(list_concat(list_concat(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
  list_transform(list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda x: x <> ''), lambda x: 'p:' || x)),
  list_transform(list_filter(list_transform(string_split(split_part(split_part(url, '#', 1), '?', 2), '&'), lambda x: split_part(x, '=', 1)), lambda x: x <> ''), lambda x: 'q:' || x))) AS tokens FROM u),
k AS (SELECT doc_id AS page_id, min(quality) = 0 AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
m AS (SELECT t.page_id, tokens, bad FROM t JOIN k USING (page_id)),
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE bad) AS n_bad FROM m),
i AS (SELECT bad, list_sort(tokens) AS tokens, unnest(range(1, CAST(pow(2, len(tokens)) AS BIGINT))) AS mask FROM m),
s AS (SELECT items, count(*) AS f, count(*) FILTER (WHERE bad) AS fb FROM (SELECT bad, list_filter(tokens, lambda x, n: (mask >> (n - 1)) & 1 = 1) AS items FROM i) GROUP BY items),
r AS (SELECT items, CAST(fb AS DOUBLE) / f AS confidence FROM s, n WHERE fb >= ceil({SUPPORT} * n) AND fb > 0 AND CAST(fb AS DOUBLE) / f >= {CONFIDENCE}
  AND (CAST(fb AS DOUBLE) / f) / (CAST(n_bad AS DOUBLE) / n) >= {LIFT}),
b AS (SELECT page_id, max(confidence) AS confidence FROM t JOIN r ON list_has_all(tokens, items) GROUP BY page_id),
v AS (SELECT *, {", ".join(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') AS f{i}" for i, (h, p, _) in enumerate(HOST_RULES, 1))} FROM t)
SELECT v.page_id, v.host, v.path, CASE {" ".join(f"WHEN f{i} THEN '{h}{p}'" for i, (h, p, _) in sorted(enumerate(HOST_RULES, 1), key=lambda x: -len(x[1][0] + x[1][1])))} END AS rule,
 CASE {" ".join(f"WHEN f{i} THEN '{d}'" for i, (h, p, d) in sorted(enumerate(HOST_RULES, 1), key=lambda x: -len(x[1][0] + x[1][1])))} WHEN confidence IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, confidence
FROM v LEFT JOIN b ON v.page_id = b.page_id
"""
