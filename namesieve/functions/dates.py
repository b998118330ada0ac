"""Date parsing. Results are ``YYYY-MM-DD`` strings or the empty string unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from namesieve.functions.text import _col, fill, let, strip, word_list

_M = r"(1[0-2]|0[1-9]|[1-9])"
_D = r"(3[0-1]|[1-2]\d|0[1-9]|[1-9])"
_Y = r"(\d{4})"

# Accepted layouts in the order they are tried, as (pattern, year, month, day group).
LAYOUTS = [
    (rf"^{_Y}-{_M}-{_D}$", 1, 2, 3),
    (rf"^{_D}/{_M}/{_Y}$", 3, 2, 1),
    (rf"^{_M}/{_D}/{_Y}$", 3, 1, 2),
    (rf"^{_Y}{_M}{_D}$", 1, 2, 3),
    (rf"^{_D}-{_M}-{_Y}$", 3, 2, 1),
    (rf"^{_Y}/{_M}/{_D}$", 1, 2, 3),
]
# English month names.
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
EMBEDDED = r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})"


def _ymd(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def _by_layout(c: Column, pattern: str, y: int, m: int, d: int) -> Column:
    group = lambda i: F.regexp_extract(c, pattern, i)
    return F.when(c.rlike(pattern), _ymd(group(y), group(m), group(d)))


def _by_month_name(c: Column) -> Column:
    pattern = rf"^{_D}\s+([A-Za-z]+)\s+{_Y}$"
    name = F.lower(F.regexp_extract(c, pattern, 2))
    full, short = word_list(MONTHS), word_list(m[:3] for m in MONTHS)
    number = F.greatest(F.array_position(full, name), F.array_position(short, name))
    day, year = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 3)
    return F.when(c.rlike(pattern) & (number > 0), _ymd(year, number.cast("string"), day))


def _embedded(inner: Column) -> Column:
    return F.coalesce(_by_layout(inner, *LAYOUTS[0]), _by_layout(inner, *LAYOUTS[5]))


def _parsed(c: Column) -> Column:
    known = [_by_layout(c, *layout) for layout in LAYOUTS]
    inner, year = F.regexp_extract(c, EMBEDDED, 1), F.regexp_extract(c, _Y, 1)
    january = F.try_to_date(F.concat(year, F.lit("-01-01")), "yyyy-MM-dd")
    rest = F.when(inner != "", let(inner, _embedded)).otherwise(F.when(year != "", january))
    return F.coalesce(*known, _by_month_name(c), rest)


def to_date_any(c) -> Column:
    """DateType from any known layout, an embedded date, or a bare year; null when none fits."""
    return let(strip(_col(c)), _parsed)


def iso(date: Column) -> Column:
    return fill(F.date_format(date, "yyyy-MM-dd"))


def parse_date(c) -> Column:
    """``to_date_any`` as an ISO string, empty when nothing was recognised."""
    return iso(to_date_any(c))


def strict_iso(c) -> Column:
    """DateType for ``Y-M-D`` text (one-digit months and days allowed), else null."""
    return _by_layout(_col(c), *LAYOUTS[0])


def iso_or_keep(c) -> Column:
    """ISO text when the value is a date, else the value itself."""
    c = _col(c)
    return F.coalesce(F.date_format(strict_iso(c), "yyyy-MM-dd"), c)


def is_year(c) -> Column:
    return F.coalesce(_col(c).rlike(r"^\d{4}$"), F.lit(False))


def latest_date(items: Column) -> Column:
    """The text of the most recent valid date in an array, empty when there is none.

    Ties keep the value that comes first.
    """
    dated = F.transform(
        items,
        lambda x, i: F.struct(strict_iso(x).alias("d"), (-i).alias("i"), x.alias("s")),
    )
    best = F.array_max(F.filter(dated, lambda e: e["d"].isNotNull()))
    return fill(best["s"])


def mrz_date(c) -> Column:
    """``YYMMDD`` to ISO text with the century fixed at 2000. No calendar check."""
    c = _col(c)
    ok = c.rlike(r"^\d{6}")
    part = lambda a: F.substring(c, a, 2)
    return F.when(ok, F.concat(F.lit("20"), part(1), F.lit("-"), part(3), F.lit("-"), part(5)))


def mrz_calendar_date(c) -> Column:
    """``YYMMDD`` to DateType (20xx), null when it is no real date."""
    return F.try_to_date(mrz_date(c), "yyyy-MM-dd")
