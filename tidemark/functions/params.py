"""Typed getters over canonical parameters, and the comparison operators of patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_INTEGER = r"^[+-]?\d+$"


def get(params: Column, name: str) -> Column:
    """A parameter's text, null without it."""
    return F.try_element_at(params, F.lit(name))


def as_string(x: Column) -> Column:
    """The text; blank is null."""
    return F.when(x.rlike(r"\S"), x)


def as_long(x: Column) -> Column:
    """An integer text within 64 bits, else null. Surrounding blanks are not allowed."""
    return F.when(x.rlike(_INTEGER), x.try_cast("bigint"))


def as_int(x: Column) -> Column:
    return F.when(x.rlike(_INTEGER), x.try_cast("int"))


def as_boolean(x: Column) -> Column:
    """True for "true" without case, false for any other text, null for null."""
    return F.lower(x) == "true"


def as_big_integer(x: Column) -> Column:
    """Canonical decimal text of an integer of any size, else null."""
    bare = F.regexp_replace(x, r"^([+-]?)0*(?=\d)", "$1")
    return F.when(x.rlike(_INTEGER), F.when(bare.rlike(r"^[+-]?0$"), F.lit("0")).otherwise(F.regexp_replace(bare, r"^\+", "")))


def as_big_decimal(x: Column, scale: int = 18) -> Column:
    """A number as DECIMAL(38, scale); null if it isn't one or doesn't fit."""
    return F.when(x.rlike(_NUMBER), x.try_cast(f"decimal(38,{scale})"))


def _sign(x: Column) -> Column:
    """Sign of an integer text."""
    return F.when(x.rlike(r"^[+-]?0+$"), F.lit(0)).when(x.startswith("-"), F.lit(-1)).otherwise(F.lit(1))


def _size(x: Column) -> Column:
    """A key by which the absolute values of integer texts of any width sort."""
    digits = F.regexp_replace(x, r"^[+-]?0*", "")
    return F.concat(F.lpad(F.length(digits).cast("string"), 9, "0"), digits)


def order(a: Column, b: Column) -> Column:
    """-1, 0 or 1: as numbers if both are, else as text.

    Integers of any width compare exactly. Other numbers compare as
    DECIMAL(38, 18), and as doubles where that doesn't hold them.
    """
    three = lambda x, y: F.when(x < y, F.lit(-1)).when(x > y, F.lit(1)).otherwise(F.lit(0))
    whole = F.when(_sign(a) != _sign(b), three(_sign(a), _sign(b))).otherwise(three(_size(a), _size(b)) * _sign(a))
    da, db = a.try_cast("decimal(38,18)"), b.try_cast("decimal(38,18)")
    other = F.when(da.isNotNull() & db.isNotNull(), three(da, db)).otherwise(three(a.try_cast("double"), b.try_cast("double")))
    numbers = a.rlike(_NUMBER) & b.rlike(_NUMBER)
    return F.when(numbers, F.when(a.rlike(_INTEGER) & b.rlike(_INTEGER), whole).otherwise(other)).otherwise(three(a, b))


def compare(operator: str, a: Column, b: Column) -> Column:
    """EQ ignores case, NE doesn't; GT, LT, GE and LE go by ``order``."""
    if operator == "EQ":
        return F.lower(a) == F.lower(b)
    if operator == "NE":
        return a != b
    o = order(a, b)
    try:
        return {"GT": o > 0, "LT": o < 0, "GE": o >= 0, "LE": o <= 0}[operator]
    except KeyError:
        raise ValueError(f"no such operator: {operator}") from None


def clean(x: Column) -> Column:
    """Lower case, without white space at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", ""))
