"""The sentences that a reader sees, each held once: columns and checking SQL both take them from here."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SILENT = "silent: no posts in the window"
FEW = " (few posts)"
LOOSE_CUT = ("Relevance cut-off ", ", others use 0.35: looser matches raise this count.")
PART_SEARCHED = ("Search reached ", " of ", " posts of the window: what it missed lowers this count.")
LOOSE_AND_PART = "looser cut-off and part of the window unsearched"
LOOSE_ONLY = "looser cut-off"
PART_ONLY = "part of the window unsearched (no vectors)"
TOGETHER = ("Sum of ", " measured events over ", " days: rate of posts on any of them, shared posts taken once")
NOTHING = "Nothing measured for these events so far."
NONE_KEPT = "search ended without a post above the cut-off"
WAITING = ("in line to be matched; done: ", " of ", "")
HOW = ("", " | cut ", " by ", " | candidates ", " | window searched to ", " % | median ", ", least ", " | on ", "")
FULL_TEXTS, SUMMARIES = "full texts", "summaries"
WHO = ("sources ", "/", ", groups ", "/", "")


def filled(sentence: Sequence[str], *values: Column) -> Column:
    """A sentence with its gaps filled; null where a value is."""
    parts = [F.lit(sentence[0])]
    for value, text in zip(values, sentence[1:], strict=True):
        parts += [value.cast("string"), F.lit(text)]
    return F.concat(*parts)


def filled_sql(sentence: Sequence[str], *values: str) -> str:
    """The same as SQL."""
    parts = [quoted(sentence[0])]
    for value, text in zip(values, sentence[1:], strict=True):
        parts += [f"({value})", quoted(text)]
    return " || ".join(parts)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
