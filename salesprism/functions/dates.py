"""Dates in several spellings, and the year rules built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesprism.functions.text import strip

# Shape of the text -> the one pattern that can read it. The shapes exclude each other, so a
# row is parsed at most once and never pays for the failed attempts of the other patterns.
DATE_SHAPES = (
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{2}$", "d MMM yy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{2}$", "d MMMM yy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    # The free-form step: the other spellings met in listings; the rest stays NULL.
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2} \d{4}$", "MMMM d yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
)
FIRST_PIVOTED_YEAR = 2069


def parse_date(col: Column) -> Column:
    """Ordinals and commas dropped, then the pattern that fits; two-digit 69-99 are 19xx."""
    return date_of(date_text(col))


def date_text(col: Column) -> Column:
    """The text without blanks around it, ordinal endings and commas."""
    return F.regexp_replace(F.regexp_replace(strip(col), r"(?i)(\d{1,2})(st|nd|rd|th)", "$1"), ",", "")


def date_of(text: Column) -> Column:
    """The date of a cleaned text by the pattern of its shape."""
    out = F.lit(None).cast("date")
    for shape, pattern in reversed(DATE_SHAPES):
        parsed = F.try_to_timestamp(text, F.lit(pattern)).cast("date")
        if pattern.endswith(" yy"):
            parsed = F.when(F.year(parsed) >= FIRST_PIVOTED_YEAR, F.add_months(parsed, -1200)).otherwise(parsed)
        out = F.when(text.rlike(shape), parsed).otherwise(out)
    return out


def known_year(year: Column, release: Column, update: Column, zero_is_null: bool = False) -> Column:
    """The stated year, else the release year, else the year of the last update.

    A stated 0 counts as known (and is clipped later) unless ``zero_is_null``.
    """
    stated = F.nullif(year, F.lit(0.0)) if zero_is_null else year
    return F.coalesce(stated, F.year(release).cast("double"), F.year(update).cast("double"))


def clip_year(year: Column, as_of_year: int, first_year: int = 1970) -> Column:
    """NULL stays NULL: ``greatest`` and ``least`` alone would skip it."""
    return F.when(
        year.isNotNull(), F.greatest(F.least(year, F.lit(float(as_of_year))), F.lit(float(first_year)))
    ).cast("int")


def quarter_label(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


def decade(year: Column) -> Column:
    return (F.floor(year / F.lit(10)) * 10).cast("int")


def age(year: Column, as_of_year: int) -> Column:
    return F.when(year.isNotNull(), F.greatest(F.lit(as_of_year) - year, F.lit(0)))
