"""Text expressions: unwrapping, cleaning, quotes, probes, fragments, keys and labels."""
from __future__ import annotations

from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsgauge.functions import wording as W


def event_fingerprint(year: Column, week: Column, name: Column) -> Column:
    return F.md5(F.concat_ws("|", year.cast("string"), week.cast("string"), name))


def json_message(text: Column) -> Column:
    """A post stored as a JSON record of kind 'Message' shows its message; anything else is itself."""
    return F.when(F.get_json_object(text, "$._") == "Message", F.get_json_object(text, "$.message")).otherwise(text)


def normalise_text(text: Column, fallback: Column, max_chars: int) -> Column:
    """Trimmed text, JSON records unwrapped when their message is not empty, else the fallback; cut with ' …'."""
    t = F.trim(F.coalesce(text, F.lit("")))
    inner = F.trim(F.get_json_object(t, "$.message"))
    body = F.when(t.startswith("{") & (F.length(inner) > 0), inner).otherwise(t)
    body = F.coalesce(F.nullif(body, F.lit("")), F.trim(F.coalesce(fallback, F.lit(""))))
    return F.when(
        F.length(body) > max_chars, F.concat(F.rtrim(F.substring(body, 1, max_chars)), F.lit(" …"))
    ).otherwise(body)


def parse_quotes(raw: Column) -> Column:
    """A list literal of quoted strings to an array; '' and '[]' are empty, unreadable text is one element.

    Items may be in single or double quotes, with backslash escapes.
    """
    t = F.trim(F.coalesce(raw, F.lit("")))
    item = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\""""       # possessive: long quotes need no stack
    whole = r"(?s)^\[\s*(?:" + item + r")(?:\s*,\s*(?:" + item + r"))*\s*,?\s*\]$"
    found = F.regexp_extract_all(t, F.lit(item), F.lit(0))
    bare = F.transform(found, lambda q: F.trim(F.regexp_replace(F.substring(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1")))
    return (
        F.when(t.isin("", "[]"), F.array().cast("array<string>"))
        .when(t.rlike(whole), F.filter(bare, lambda q: q != ""))
        .otherwise(F.array(t))
    )


def build_probes(name: Column, quotes: Column) -> Column:
    """The event name, each bare quote and all of them joined; ordered, without repeats or blanks."""
    bare = F.transform(quotes, lambda q: F.btrim(q, F.lit('«»" ')))
    combined = F.array_join(F.concat(F.array(name), bare), ". ")
    return F.filter(F.array_distinct(F.concat(F.array(name), bare, F.array(combined))), lambda p: p != "")


def guillemet_quotes(text: Column) -> Column:
    """Every «…» of a text, joined by two spaces."""
    return F.array_join(F.regexp_extract_all(text, F.lit("«[^»]*»"), F.lit(0)), "  ")


def keyword_match(pattern: str, *texts: Column) -> Column:
    """True if any of the texts holds a case-insensitive Unicode match."""
    hit = F.lit(False)
    for t in texts:
        hit = hit | F.coalesce(t.rlike(f"(?iu){pattern}"), F.lit(False))
    return hit


def short_count(text: Column) -> Column:
    """'1.2K' and '3M' to whole numbers; anything else is NULL."""
    pattern = r"^([0-9.]+)\s*([KM]?)$"
    t = F.trim(text)
    number = F.regexp_extract(t, pattern, 1).try_cast("double")
    unit = F.regexp_extract(t, pattern, 2)
    scale = F.when(unit == "K", 1_000).when(unit == "M", 1_000_000).otherwise(1)
    return F.when(t.rlike(pattern), F.round(number * scale).cast("long"))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_text(text: Column) -> Column:
    """Without links, @handles, '#', symbols and format characters; single spaces."""
    t = F.regexp_replace(text, r"(?i)(https?://\S+|t\.me/\S+|www\.\S+)", " ")
    t = F.regexp_replace(t, r"(?U)(?<!\w)@\w+", " ")
    t = F.replace(t, F.lit("#"), F.lit(" "))
    t = F.regexp_replace(t, r"[\p{So}\p{Sk}\p{Cs}\p{Co}\p{Cf}\p{Cn}]", "")
    return squeeze(t)


def fragments(text: Column, width: int = 650, overlap: int = 120) -> Column:
    """Overlapping pieces of a text; the last one ends where the text ends; an empty text has none."""
    step = width - overlap
    last = F.greatest(F.ceil((F.length(text) - F.lit(width)) / F.lit(step)), F.lit(0)).cast("int")
    starts = F.sequence(F.lit(0), last)
    pieces = F.transform(starts, lambda i: F.substring(text, i * step + 1, F.lit(width)))
    return F.when(F.length(text) > 0, pieces).otherwise(F.array().cast("array<string>"))


def wording_normalised(name: Column) -> Column:
    """Lower case, ё as е, punctuation as spaces, single spaces."""
    t = F.translate(F.lower(name), "ё", "е")
    return squeeze(F.regexp_replace(t, r"[«»\"“”„.,:;!?()\-–—]", " "))


def wording_key(name: Column) -> Column:
    return F.concat(F.lit("k"), F.substring(F.sha1(wording_normalised(name)), 1, 10))


def percent_value(text: Column) -> Column:
    """A number or '12%' to a double, else NULL."""
    return F.trim(F.replace(text, F.lit("%"), F.lit(""))).try_cast("double")


def report_year_week(file_name: Column, overrides: dict[str, tuple[int, int]] | None = None) -> Column:
    """Year and week out of a report file name; listed files take their fixed pair instead."""
    pattern = r"^d(\d+)sn(\d{4})\.pdf"
    year = F.regexp_extract(file_name, pattern, 2).try_cast("int")
    week = F.regexp_extract(file_name, pattern, 1).try_cast("int")
    found = F.struct(year.alias("year"), week.alias("week"))
    for name, (y, w) in (overrides or {}).items():
        found = F.when(file_name == name, F.struct(F.lit(y).alias("year"), F.lit(w).alias("week"))).otherwise(found)
    return found


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def fixed_point(x: Column, digits: int) -> Column:
    """A non-negative double printed with `digits` decimals, rounded on its exact binary value as C's printf does.

    Only values next to a tie need care: there the sign of 2·10^d·x minus the tie is found without
    rounding error by splitting x into a 24-bit part and the rest.
    """
    scale = 10 ** digits
    doubled = F.rint(x * (2 * scale))
    high = x.cast("float").cast("double")
    rest = (high * (2 * scale) - doubled) + (x - high) * (2 * scale)
    near_tie = (doubled % 2 == 1) & (F.abs(x * (2 * scale) - doubled) < 1e-6)
    below = F.floor(doubled / 2)
    tie = F.when(rest > 0, below + 1).when(rest < 0, below).otherwise(below + below % 2)
    n = F.when(near_tie, tie).otherwise(F.rint(x * scale).cast("long"))
    whole, part = F.floor(n / scale), n % scale
    return F.concat(whole.cast("string"), F.lit("."), F.lpad(part.cast("string"), digits, "0"))


def coverage_cell(posts: Column, per_1000: Column, published: Column) -> Column:
    """A group's coverage as text with its three zeros apart: not publishing, none of N, too few to compare."""
    noun = F.when(posts == 1, " post").otherwise(" posts")
    few = F.when(posts < 5, W.FEW).otherwise("")
    return (
        F.when(F.coalesce(published, F.lit(0)) == 0, W.SILENT)
        .when(posts == 0, F.concat(F.lit("0 of "), thousands(published), F.lit(" posts")))
        .otherwise(F.concat(fixed_point(per_1000, 1), F.lit(" · "), thousands(posts), noun, few))
    )


def trust_warning(standard_cutoff: Column, threshold: Column, searchable_share: Column,
                  searchable: Column, published: Column) -> Column:
    """Two separate reasons a count cannot be compared, joined; NULL when neither holds."""
    cut = F.when(~standard_cutoff, W.filled(W.LOOSE_CUT, threshold))
    seen = F.when(searchable_share < 0.9, W.filled(W.PART_SEARCHED, thousands(searchable), thousands(published)))
    return F.nullif(F.concat_ws(" ", cut, seen), F.lit(""))


def estimated_tokens(text: Column, chars_per_token: float = 2.2, overhead: int = 2125) -> Column:
    return F.floor(F.length(text) / F.lit(chars_per_token)).cast("long") + F.lit(overhead)


def uniform(seed: str, *parts: Column) -> Column:
    """A reproducible number in [0, 1) from a seed and an id."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _references() -> dict[str, str]:
    """Character references by what stands behind '&': names as HTML lists them, and the numbers that stand for Windows characters."""
    windows = {f"#{i}": bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160)}
    return {**html5, **windows, "#0": "\ufffd"}


def decoded_references(text: Column) -> Column:
    """Named and numeric character references as characters, in one pass; what is no reference stays. A name needs its semicolon, but for the old ones followed by no letter."""
    table = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in _references().items())), F.lit("\x01"), F.lit("\x02"))
    parts = F.regexp_extract_all(text, F.lit(r"(?s)&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]*+;?)|[^&]+|&"), F.lit(0))

    def char(part: Column) -> Column:
        sixteen = part.rlike("^&#[xX]")
        digits = F.regexp_extract(part, "^&#[xX]?([0-9a-fA-F]+)", 1)
        n = F.when(sixteen, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        wrong = n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        number = F.coalesce(F.when(n < 160, table[F.concat(F.lit("#"), n.cast("string"))]), F.when(wrong, "\ufffd").otherwise(plain))
        named = F.coalesce(table[F.substring(part, 2, F.length(part))], part)
        return F.when(~part.startswith("&"), part).when(part.rlike("^&#"), F.coalesce(number, part)).otherwise(named)
    return F.when(text.contains("&"), F.array_join(F.transform(parts, char), "")).otherwise(text)


def balanced(html: Column) -> Column:
    """What stands before the end tag that closes an element already open, elements inside it included; without one, all of it."""
    tokens = F.regexp_extract_all(html, F.lit(r"(?s)<[^>]*>|[^<]++|<"), F.lit(0))
    # Elements that have no end tag.
    void = r"(?i)^<(?:area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr)\b|/>$"
    step = lambda t: F.when(t.startswith("</"), -1).when(t.rlike(void), 0).when(t.rlike("^<[A-Za-z]"), 1).otherwise(0)
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("kept"))

    def fold(state: Column, by: Column) -> Column:
        depth = F.when(state["depth"] > 0, state["depth"] + by).otherwise(0)
        return F.struct(depth.alias("depth"), (state["kept"] + (depth > 0).cast("int")).alias("kept"))
    return F.array_join(F.slice(tokens, F.lit(1), F.aggregate(F.transform(tokens, step), start, fold)["kept"]), "")


def element_text(html: Column) -> Column:
    """Visible text of one element: block tags are spaces, other tags vanish, character references decoded, white space single."""
    t = F.regexp_replace(html, r"(?i)</?(?:br|p|blockquote|div)\b[^>]*>", " ")
    t = decoded_references(F.regexp_replace(t, r"<[^>]*>", ""))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
