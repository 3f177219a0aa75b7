"""Calendar expressions: ISO weeks, event windows, boundary-counting offsets, date labels."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_week_monday(year: Column, week: Column) -> Column:
    """Monday of an ISO week; the 4th of January always lies in week 1."""
    first = F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date")
    return F.date_add(first, ((week - 1) * 7).cast("int"))


def iso_year(day: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), day).cast("int")


def hours_between(start: Column, end: Column) -> Column:
    """Hour boundaries crossed between two instants (00:50 to 01:10 is one)."""
    def hour(c: Column) -> Column:
        return F.unix_timestamp(F.date_trunc("hour", c.cast("timestamp")))

    return ((hour(end) - hour(start)) / 3600).cast("long")


def window_days(start: Column, end_exclusive: Column) -> Column:
    """Every calendar day of a half-open window, one row each."""
    return F.explode(F.sequence(start, F.date_sub(end_exclusive, 1)))


def week_key(year: Column, week: Column) -> Column:
    """'2025-W03'."""
    return F.format_string("%d-W%02d", year.cast("int"), week.cast("int"))


def date_range_label(start: Column, end: Column) -> Column:
    """'3–9 Mar 2025', '31 Mar – 6 Apr 2025', '30 Dec 2024 – 5 Jan 2025'."""
    return (
        F.when(F.year(start) != F.year(end),
               F.concat(F.date_format(start, "d MMM yyyy"), F.lit(" – "), F.date_format(end, "d MMM yyyy")))
        .when(F.month(start) != F.month(end),
              F.concat(F.date_format(start, "d MMM"), F.lit(" – "), F.date_format(end, "d MMM yyyy")))
        .otherwise(F.concat(F.date_format(start, "d"), F.lit("–"), F.date_format(end, "d MMM yyyy")))
    )


# Month names in the genitive, as survey reports print them, January to December.
REPORT_MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября",
                 "ноября", "декабря"]


def survey_week_from_phrase(text: Column, file_year: Column, marker: str = "Опрос",
                            months: list[str] = REPORT_MONTHS) -> Column:
    """ISO (year, week) of a survey's last day, read from a phrase like 'Опрос 14–16 марта 2025 г.'.

    A phrase without a year takes the file's year; text without a known month gives NULL.
    """
    pattern = rf"(?s){marker}[^\n]*?(\d{{1,2}})\s+(\p{{L}}+)(?:\s+(\d{{4}}))?\s*(?:г\.)?\s*\."
    month = F.array_position(F.array(*[F.lit(m) for m in months]), F.regexp_extract(text, pattern, 2))
    year = F.coalesce(F.regexp_extract(text, pattern, 3).try_cast("int"), file_year.cast("int"))
    number = F.regexp_extract(text, pattern, 1)
    iso_text = F.format_string("%04d-%02d-%02d", year, month.cast("int"), number.try_cast("int"))
    day = F.when(month > 0, iso_text.try_cast("date"))
    return F.when(day.isNotNull(), F.struct(iso_year(day).alias("year"), F.weekofyear(day).alias("week")))
