"""Dates, years and months as gazettes write them, and windows of days."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms
from .text import any_of, let, norm_text
from .urls import unquote

DAY, MONTH = r"(0?[1-9]|[12]\d|3[01])", r"(0?[1-9]|1[0-2])"
FULL_DAY, FULL_MONTH = r"(0[1-9]|[12]\d|3[01])", r"(0[1-9]|1[0-2])"


def _date(x: Column, pattern: str, y: int, m: int | str, d: int) -> Column:
    """The date of the pattern's first match, by the numbers of its groups; null if there is none or the day doesn't exist."""
    year = F.regexp_extract(x, pattern, y)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    month = F.lit(m) if isinstance(m, str) else F.lpad(F.regexp_extract(x, pattern, m), 2, "0")
    return F.when(x.rlike(pattern), F.try_to_date(F.concat_ws("-", year, month, F.lpad(F.regexp_extract(x, pattern, d), 2, "0")), "yyyy-MM-dd"))


def publication_date(value: Column) -> Column:
    """The publication date that a text states, by the first of four forms that gives a real day: yyyymmdd, d.m.y with any separators, ddmmyyyy, and a day with a French month name.

    Of each form only the first match counts. Dates of the form yyyy-mm-dd aren't read as such.
    """
    return let(norm_text(unquote(F.coalesce(value, F.lit("")))), _forms)


def _forms(x: Column) -> Column:
    forms = [
        _date(x, rf"(?<!\d)(20\d{{2}}){FULL_MONTH}{FULL_DAY}(?!\d)", 1, 2, 3),
        _date(x, rf"(?<!\d){DAY}[\s._/-]+{MONTH}[\s._/-]+(20\d{{2}}|\d{{2}})(?!\d)", 3, 2, 1),
        _date(x, rf"(?<!\d){FULL_DAY}{FULL_MONTH}(20\d{{2}})(?!\d)", 3, 2, 1),
    ]
    forms += [_date(x, rf"(?<!\d){DAY}\s+{name}\s+(20\d{{2}})(?!\d)", 2, f"{n:02d}", 1) for n, name in enumerate(terms.MONTHS, 1)]
    return F.coalesce(*forms)


def date_with_source(*values: tuple[str, Column]) -> Column:
    """(publication_date as text, date_source) of the first value with a date; ('', 'unknown') for none."""
    found = [F.when(d.isNotNull(), F.struct(d.cast("string").alias("publication_date"), F.lit(s).alias("date_source"))) for s, d in ((s, publication_date(v)) for s, v in values)]
    return F.coalesce(*found, F.struct(F.lit("").alias("publication_date"), F.lit("unknown").alias("date_source")))


def year_in(*values: Column) -> Column:
    """The latest year from 2010 to 2035 in the first value that has one."""

    def latest(x):
        own = F.lit(None).cast("string")
        for y in terms.YEARS:
            own = F.when(x.contains(str(y)), str(y)).otherwise(own)
        return own

    return F.coalesce(*[let(unquote(v), latest) for v in values])


def month_in(*values: Column) -> Column:
    """The English name of the first month, in the year's order, that the first value with one names in French; else empty."""

    def first(x):
        own = F.lit(None).cast("string")
        for french, english in reversed(terms.MONTHS.items()):
            own = F.when(x.contains(french), english).otherwise(own)
        return own

    return F.coalesce(*[let(norm_text(unquote(F.coalesce(v, F.lit("")))), first) for v in values], F.lit(""))


def years_of(x: Column) -> Column:
    return F.array_compact(F.array(*[F.when(x.contains(str(y)), str(y)) for y in terms.YEARS]))


def months_of(x: Column) -> Column:
    return F.array_compact(F.array(*[F.when(x.contains(m), m) for m in terms.MONTHS]))


def month_scope(months: Iterable[str] | None) -> list[str]:
    """Month names in French and English, normalised, with the French name of each English one."""
    import unicodedata

    fold = lambda s: " ".join(unicodedata.normalize("NFKD", str(s)).encode("ascii", "ignore").decode().lower().split())
    out = []
    for m in filter(None, map(fold, months or ())):
        out += [m, *[f for f, e in terms.MONTHS.items() if e.lower() == m]]
    return list(dict.fromkeys(out))


def in_scope(combined: Column, years: Iterable[str] | None, months: Iterable[str] | None) -> Column:
    """Whether a normalised text fits the years and months: another year or month speaks against it, one of them for it, none for it too."""
    years, months = [str(y) for y in years or ()], month_scope(months)
    return let(combined, lambda x: _fits(x, years, months)) if years or months else F.lit(True)


def _fits(combined: Column, years: list[str], months: list[str]) -> Column:
    ys, ms = years_of(combined), months_of(combined)
    lit = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    in_years, in_months = F.arrays_overlap(ys, lit(years)), F.arrays_overlap(ms, lit(months))
    out = F.when((F.size(ys) > 0) & F.lit(bool(years)) & ~in_years, False).when((F.size(ms) > 0) & F.lit(bool(months)) & ~in_months, False)
    return out.when(in_years | in_months, True).otherwise((F.size(ys) == 0) & (F.size(ms) == 0))


def window_bounds(days: int | None, today: date | None = None) -> tuple[date, date] | tuple[None, None]:
    """The last days, today included; (None, None) for no window."""
    from datetime import timedelta

    if days is None or days <= 0:
        return None, None
    end = today or date.today()
    return end - timedelta(days=days - 1), end


def in_window(published: Column, days: int | None, today: date | None = None) -> Column:
    """Whether a date as text lies in the window. Without a window all do; a blank or broken date lies in none."""
    lo, hi = window_bounds(days, today)
    return F.lit(True) if lo is None else F.coalesce(F.try_to_date(published, "yyyy-MM-dd").between(F.lit(lo), F.lit(hi)), F.lit(False))


def current_months(today: date) -> list[tuple[str, int, str]]:
    """(English month, year, yyyy-mm) of the current month, the only one that a daily run covers."""
    return [(list(terms.MONTHS.values())[today.month - 1], today.year, f"{today:%Y-%m}")]


def in_months(published: Column, year: Column, month: Column, scope: list[tuple[str, int, str]]) -> Column:
    """Whether a document belongs to the months: by its date, or without one by its year and month labels."""
    by_label = F.lit(False)
    for name, y, _ in scope:
        by_label = by_label | ((year == str(y)) & (month == name))
    date_ = F.coalesce(published, F.lit(""))
    return F.when(F.length(date_) >= 7, F.substring(date_, 1, 7).isin([s[2] for s in scope])).otherwise(F.coalesce(by_label, F.lit(False)))


def names_year_or_month(combined: Column) -> Column:
    return any_of(combined, terms.MONTHS) | any_of(combined, map(str, terms.YEARS))
