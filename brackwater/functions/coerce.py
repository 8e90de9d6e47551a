"""Coercions of text columns: flags, numbers, lists, JSON; with defaults, hard errors, or nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for flags; fixed values.
TRUE = ("true", "1", "yes", "y")
FALSE = ("false", "0", "no", "n")


def blank(c: Column) -> Column:
    """True for null and for white space alone."""
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def flag(c: Column, default: bool = False, strict: bool = True) -> Column:
    """A boolean of a flag word; ``default`` if blank; other words are an error, or null where not ``strict``."""
    word = F.lower(F.trim(c.cast("string")))
    other = F.raise_error(F.concat(F.lit("invalid boolean value: "), word)).cast("boolean") if strict else F.lit(None).cast("boolean")
    return F.when(blank(c), F.lit(default)).when(word.isin(*TRUE), True).when(word.isin(*FALSE), False).otherwise(other)


def integer(c: Column, default: int, name: str, strict: bool = True) -> Column:
    """A whole number; ``default`` if blank; anything else is an error that names the column, or null."""
    text = F.trim(c.cast("string"))
    number = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("long"))
    other = F.raise_error(F.concat(F.lit(f"invalid integer for {name}: "), text)).cast("long") if strict else F.lit(None).cast("long")
    return F.when(blank(c), F.lit(default).cast("long")).otherwise(F.coalesce(number, other))


def number(c: Column) -> Column:
    """A finite double, else null; booleans are no numbers, their text neither."""
    value = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def parts(c: Column) -> Column:
    """Parts between commas or bars, trimmed, empty ones left out; an empty array for null."""
    every = F.transform(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit(",")), ","), lambda x: F.trim(x))
    return F.filter(every, lambda x: x != "")


def json_list(c: Column, item: str = "string") -> Column:
    """A JSON array; an empty one where the text is null or no JSON array."""
    return F.coalesce(F.from_json(c, f"array<{item}>"), F.array().cast(f"array<{item}>"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
