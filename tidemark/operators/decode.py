"""ABI decoding compiled to Spark expressions.

A payload is hex digits without a prefix. Types are laid out as the contract ABI
says: a static tuple or fixed array takes as many words of the head as it has,
and dynamic values are found by offsets from the start of the enclosing tuple or
array. Expressions never raise: whatever is out of bounds or malformed is null.

``typed`` gives the values in their own Spark types. ``canonical`` gives text: a
decimal for integers, JSON for arrays and tuples, and for ``bytes`` and
``bytesN`` the head word as it stands, which is what indexers have stored so far.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import words as W

from .registry import Abi, Param

_ARRAY = re.compile(r"^(.*)\[(\d*)\]$")
_SCALAR = re.compile(r"^(address|bool|string|bytes|bytes([1-9]|[12]\d|3[0-2])|u?int(\d*))$")


def known(p: Param) -> bool:
    """Whether values of the type can be decoded."""
    if m := _ARRAY.match(p.type):
        return known(Param(p.name, m[1], components=p.components))
    if p.type == "tuple":
        return all(map(known, p.components))
    m = _SCALAR.match(p.type)
    return bool(m) and (not m[3] or 8 <= int(m[3]) <= 256)


def dynamic(p: Param) -> bool:
    if m := _ARRAY.match(p.type):
        return not m[2] or dynamic(Param("", m[1], components=p.components))
    if p.type == "tuple":
        return any(map(dynamic, p.components))
    return p.type in ("string", "bytes")


def head_words(p: Param) -> int:
    """Words of the head that a value takes."""
    if dynamic(p):
        return 1
    if m := _ARRAY.match(p.type):
        return int(m[2]) * head_words(Param("", m[1], components=p.components))
    return sum(map(head_words, p.components)) if p.type == "tuple" else 1


def _scalar(kind: str, w: Column) -> Column:
    """A static value of one word."""
    if kind == "address":
        return W.address(w)
    if kind == "bool":
        return W.boolean(w)
    if kind.startswith("uint"):
        return W.uint(w)
    if kind.startswith("int"):
        return W.sint(w)
    return F.concat(F.lit("0x"), F.substring(w, 1, 2 * int(kind[5:])))


def value(p: Param, data: Column, head: Column | int, base: Column | int = 0) -> Column:
    """The value whose head is at digit ``head``; offsets count from digit ``base``."""
    head = F.lit(head) if isinstance(head, int) else head
    base = F.lit(base) if isinstance(base, int) else base
    if dynamic(p):
        return W.let(base + W.small(W.word(data, head)) * 2, lambda at: F.when(at.isNotNull(), _body(p, data, at)))
    return _body(p, data, head)


def _body(p: Param, data: Column, at: Column) -> Column:
    """The value whose own words start at digit ``at``."""
    if m := _ARRAY.match(p.type):
        item = Param("", m[1], components=p.components)
        step = 64 * head_words(item)
        if m[2]:
            return _items(item, data, F.lit(int(m[2])), at, step)
        return W.let(W.small(W.word(data, at)), lambda n: F.when(n.isNotNull(), _items(item, data, n, at + 64, step)))
    if p.type == "tuple":
        cells, place = [], 0
        for c in p.components:
            cells.append(value(c, data, at + place, at).alias(c.name or f"_{len(cells)}"))
            place += 64 * head_words(c)
        whole = F.struct(*cells)
        return W.let(whole, lambda s: F.when(_all(s, p), s))
    if p.type in ("string", "bytes"):

        def content(n: Column) -> Column:
            digits = F.substring(data, at + 65, (n * 2).cast("int"))
            found = W.text(digits) if p.type == "string" else F.concat(F.lit("0x"), digits)
            return F.when(n.isNotNull() & (F.length(data) >= at + 64 + n * 2), found)

        return W.let(W.small(W.word(data, at)), content)
    return _scalar(p.type, W.word(data, at))


def _all(s: Column, p: Param) -> Column:
    ok = F.lit(True)
    for i, c in enumerate(p.components):
        ok = ok & s[c.name or f"_{i}"].isNotNull()
    return ok


def _items(item: Param, data: Column, n: Column, start: Column, step: int) -> Column:
    """``n`` neighbouring values; null if one of them is."""
    count = F.when((n >= 0) & (F.length(data) >= start + n * step), n)
    found = F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: value(item, data, start + i * step, start))
    empty = F.slice(F.transform(F.array(F.lit(0)), lambda i: value(item, data, start, start)), F.lit(1), F.lit(0))
    return W.let(F.when(count > 0, found).when(count == 0, empty), lambda a: F.when(~F.exists(a, lambda x: x.isNull()), a))


def typed(params: Sequence[Param], data: Column) -> list[Column]:
    """Typed columns of a payload, named as the parameters; null where one can't be decoded."""
    out, place = [], 0
    for i, p in enumerate(params):
        name = p.name or f"_{i}"
        out.append((value(p, data, place) if known(p) else F.lit(None).cast("string")).alias(name))
        place += 64 * head_words(p)
    return out


def _text(p: Param, v: Column) -> Column:
    return F.to_json(v) if _ARRAY.match(p.type) or p.type == "tuple" else v.cast("string")


def _canonical(p: Param, data: Column, place: int) -> Column:
    if not known(p):
        return F.lit(None).cast("string")
    if p.type.startswith("bytes") and not _ARRAY.match(p.type):
        return F.concat(F.lit("0x"), W.word(data, place))
    return _text(p, value(p, data, place))


def event_params(abi: Abi, topics: Column, data: Column, bare: Sequence[Column] | None = None) -> Column:
    """MAP of name to canonical text. What can't be decoded is the raw topic, or ``0x`` outside the topics.

    ``bare`` has the topics without prefix, where they have a column of their own.
    """
    cells: dict[str, Column] = {}  # the last of several inputs of one name counts
    topic, place = 1, 0
    for i, p in enumerate(abi.inputs):
        if p.indexed:
            raw = F.get(topics, F.lit(topic))
            static = _SCALAR.match(p.type) and not dynamic(p) and known(p)
            own = bare[topic] if bare and topic < len(bare) else W.strip0x(raw)
            got = raw if not static or p.type.startswith("bytes") else F.when(F.length(own) == 64, _scalar(p.type, own)).cast("string")
            cell, topic = F.coalesce(got, raw), topic + 1
        else:
            cell = F.coalesce(_canonical(p, data, place), F.lit("0x"))
            place += 64 * head_words(p)
        cells[p.name or f"_{i}"] = cell
    return F.create_map(*[c for n, v in cells.items() for c in (F.lit(n), v)]) if cells else F.create_map().cast("map<string,string>")


def typed_view(abi: Abi, topics: Column, data: Column) -> list[Column]:
    """Typed columns of all parameters of an event."""
    rest = iter(typed([p for p in abi.inputs if not p.indexed], data))
    out, topic = [], 1
    for i, p in enumerate(abi.inputs):
        if p.indexed:
            raw = F.get(topics, F.lit(topic))
            topic += 1
            bare = F.when(F.length(W.strip0x(raw)) == 64, W.strip0x(raw))
            out.append((_scalar(p.type, bare) if not dynamic(p) and _SCALAR.match(p.type) and known(p) else raw).alias(p.name or f"_{i}"))
        else:
            out.append(next(rest))
    return out


def returns(outputs: Sequence[Param], raw: Column) -> list[Column]:
    """Typed columns of a call's return data, with or without a prefix and a four-byte selector."""
    bare = W.strip0x(raw)
    return typed(outputs, F.when(F.length(bare) % 64 == 8, F.substring(bare, 9, 1 << 30)).otherwise(bare))
