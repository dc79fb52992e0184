"""Scalar functions on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(c: Column) -> Column:
    """Empty after all Unicode white space is taken off; null stays null."""
    return c.rlike(r"(?U)^\s*$")


def is_code(c: Column) -> Column:
    """A-Z, 0-9 and underscores, with at least one that is no underscore."""
    return c.rlike(r"^[A-Z0-9_]*[A-Z0-9][A-Z0-9_]*$")


def is_month_day(c: Column) -> Column:
    """A day of a common year as M-d or MM-dd."""
    return c.rlike(r"^\d{1,2}-\d{1,2}$") & F.try_to_timestamp(F.concat(F.lit("1900-"), c), F.lit("yyyy-M-d")).isNotNull()


def is_country_code(c: Column) -> Column:
    return (F.length(F.trim(c)) == 2) & (c == F.upper(c))


def round_half_even(c: Column, digits: int = 2) -> Column:
    return F.bround(c, digits)


def round_half_up(c: Column, digits: int = 2) -> Column:
    return F.round(c, digits)


def month_day(d: Column) -> Column:
    return F.date_format(d, "MM-dd")


def is_weekend(d: Column) -> Column:
    return F.weekday(d) >= 5


def only_alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def clamp(c: Column, low, high) -> Column:
    """The upper bound wins where the bounds cross."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.least(high, F.greatest(low, c))


def path_part(path: Column, key: str) -> Column:
    """The value of key=value in a path; null if there is none."""
    found = F.regexp_extract(path, rf"/{key}=([^/]+)/", 1)
    return F.when(found != "", found)


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *[F.trim(p, F.lit("/")) for p in parts])


def first_true(cases: list[tuple[Column, str]], other: str) -> Column:
    """The value of the first case that holds."""
    start = F.when(*[cases[0][0], F.lit(cases[0][1])])
    return reduce(lambda c, case: c.when(case[0], case[1]), cases[1:], start).otherwise(other)


def split_name(name: Column) -> tuple[Column, Column]:
    words = F.split(F.trim(name), r"\s+")
    return F.element_at(words, 1), F.element_at(words, -1)
