"""Hex words as Spark expressions. A word is 64 hex digits without a prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest byte offset or length that a payload may name.
_LONGEST = 1 << 30


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def strip0x(x: Column) -> Column:
    return F.when(x.startswith("0x"), F.substring(x, 3, 1 << 30)).otherwise(x)


def add0x(x: Column) -> Column:
    return F.when(x.startswith("0x"), x).otherwise(F.concat(F.lit("0x"), x))


def is_hex(x: Column) -> Column:
    return x.rlike("^[0-9a-fA-F]+$")


def word(data: Column, at: Column | int) -> Column:
    """The 64 digits of ``data`` from digit ``at`` on; null if they are not all there."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when((at >= 0) & (F.length(data) >= at + 64), F.substring(data, at + 1, F.lit(64)))


def _long(digits: Column) -> Column:
    """Up to 15 hex digits as a long."""
    return F.conv(digits, 16, 10).cast("bigint")


def small(w: Column) -> Column:
    """A word as a long if it can be a byte offset or a length, else null."""
    return F.when(w.startswith("0" * 49) & is_hex(w), F.when(_long(F.substring(w, 50, 15)) <= _LONGEST, _long(F.substring(w, 50, 15))))


def _digits(w: Column, more: int) -> Column:
    """Decimal text of any word plus ``more``: base 10**9 digits by Horner's rule over 32-bit limbs."""
    limbs = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(w, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint") + F.when(i == 7, F.lit(more)).otherwise(0))

    def step(acc: Column, limb: Column) -> Column:
        start = F.struct(limb.alias("c"), F.array().cast("array<bigint>").alias("out"))

        def one(s: Column, d: Column) -> Column:
            t = d * F.lit(1 << 32) + s["c"]
            return F.struct(F.call_function("div", t, F.lit(10**9)).alias("c"), F.concat(s["out"], F.array(t % F.lit(10**9))).alias("out"))

        return F.aggregate(acc, start, one, lambda s: s["out"])

    base = F.aggregate(limbs, F.array_repeat(F.lit(0).cast("bigint"), 9), step)
    text = F.array_join(F.transform(F.reverse(base), lambda d: F.lpad(d.cast("string"), 9, "0")), "")
    return F.regexp_replace(text, "^0+(?=.)", "")


def uint(w: Column) -> Column:
    """A word as canonical decimal text; null if it isn't hex. Values below 2**60 take a short way."""
    low = F.substring(w, 50, 15)
    long_ = F.when((F.length(w) == 64) & is_hex(w), let(w, lambda x: _digits(x, 0)))
    return F.when(w.startswith("0" * 49) & is_hex(low), F.conv(low, 16, 10)).otherwise(long_)


def sint(w: Column) -> Column:
    """A sign-extended word as canonical decimal text."""

    def text(x: Column) -> Column:
        other = F.translate(F.lower(x), "0123456789abcdef", "fedcba9876543210")
        low = F.when(other.startswith("0" * 49), (-_long(F.substring(other, 50, 15)) - 1).cast("string")).otherwise(F.concat(F.lit("-"), _digits(other, 1)))
        return F.when(x.rlike("^[89a-fA-F]"), low).otherwise(uint(x))

    return F.when(is_hex(w), let(w, text))


def address(w: Column) -> Column:
    return F.when(F.length(w) == 64, F.concat(F.lit("0x"), F.substring(w, 25, 40)))


def boolean(w: Column) -> Column:
    return F.when(is_hex(w), w.rlike("^0*1$"))


def text(digits: Column) -> Column:
    """Hex digits as UTF-8, with the replacement character for what isn't."""
    return F.make_valid_utf8(F.try_to_binary(digits, F.lit("hex")).cast("string"))


def quantity(x: Column) -> Column:
    """A hex amount, with or without a prefix, as decimal text; null if it is not hex or longer than a word."""
    bare = strip0x(x)
    return F.when(is_hex(bare) & (F.length(bare) <= 64), uint(F.lpad(bare, 64, "0")))


def encode_uint(x: Column) -> Column:
    """A non-negative long as a word."""
    return F.lpad(F.lower(F.hex(x.cast("bigint"))), 64, "0")


def encode_int(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x.cast("bigint"))), 64, F.when(x < 0, F.lit("f")).otherwise(F.lit("0")))


def encode_address(x: Column) -> Column:
    """A key as an address."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(x.cast("bigint"))), 40, "0"))


def encode_string(x: Column) -> Column:
    """Length word and padded bytes of a text."""
    raw = F.lower(F.hex(x.cast("binary")))
    padded = F.rpad(raw, (F.ceil(F.length(raw) / 64) * 64).cast("int"), F.lit("0"))
    return F.concat(encode_uint(F.octet_length(x)), padded)
