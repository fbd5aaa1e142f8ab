"""Business events: patterns over the decoded events of one transaction.

A definition names aliases, each an event type with conditions; rules compare
aliases, and parameters are taken from them. Definitions go in order of their
files, and an event that one has used is gone for the later ones.

The plan depends on the definitions:

* a definition of one alias without rules is a filter and a projection;
* one whose aliases have different event types, so no event can fill two of
  them, takes the k-th candidate of each alias for its k-th match: numbering
  and a join on the number;
* these two hold where no earlier definition uses its types. For the rest a
  transaction's events go through the matching loop together, after
  transactions that lack a needed type are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import params as P
from tidemark.schemas import FIELDS, INDEXED_EVENT, TRANSFER
from tidemark.sources import files

from .events import event_id


@dataclass(frozen=True)
class Condition:
    first: str
    first_static: bool
    second: str
    second_static: bool
    operator: str


@dataclass(frozen=True)
class Alias:
    event: str
    alias: str
    conditions: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Rule:
    first: str
    first_property: str
    second: str
    second_property: str
    operator: str


@dataclass(frozen=True)
class Taken:
    name: str
    alias: str
    as_name: str


@dataclass(frozen=True)
class Definition:
    name: str
    aliases: tuple[Alias, ...] = ()
    rules: tuple[Rule, ...] = ()
    params: tuple[Taken, ...] = ()
    same_clause: bool = False
    every_combination: bool = False
    max_attempts: int = 10

    @classmethod
    def of(cls, x: Mapping) -> Definition:
        """From an entry of a definition file; numbers as operands become text."""
        return cls(
            x["name"],
            tuple(Alias(e["name"], e["alias"], tuple(Condition(str(c["firstOperand"]), bool(c.get("isFirstStatic")), str(c["secondOperand"]), bool(c.get("isSecondStatic")), c["operator"]) for c in e.get("conditions") or ())) for e in x.get("events") or ()),
            tuple(Rule(r["firstEventName"], r["firstEventProperty"], r["secondEventName"], r["secondEventProperty"], r["operator"]) for r in x.get("rules") or ()),
            tuple(Taken(p["name"], p["eventName"], p["businessEventName"]) for p in x.get("paramsDefinition") or ()),
            x.get("sameClause") is True,
            x.get("checkAllCombinations") is True,
            int(x.get("maxAttempts") or 10),
        )


def load(base: str | Path, names: Iterable[str] = (), values: Mapping[str, str] | None = None) -> list[Definition]:
    """Definitions of all JSON files below a folder, in order of path; the first of a name counts."""
    out: dict[str, Definition] = {}
    for x in files.load_all(files.find(base, ".json"), values):
        d = Definition.of(x)
        out.setdefault(d.name.lower(), d)
    wanted = {n.lower() for n in names}
    if missing := wanted - out.keys():
        raise ValueError(f"no business event named: {', '.join(sorted(missing))}")
    return [d for k, d in out.items() if not wanted or k in wanted]


def needs_transfers(definitions: Iterable[Definition]) -> bool:
    return any(a.event == TRANSFER for d in definitions for a in d.aliases)


def abi_names(definitions: Iterable[Definition]) -> list[str]:
    """Event names that the registry must hold for these definitions."""
    return list(dict.fromkeys(a.event for d in definitions for a in d.aliases if a.event.strip() and a.event != TRANSFER))


# Expressions


def operand(name: str, prefix: str = "") -> Column:
    """A parameter of that name, else a field of the event, as text."""
    found = [P.get(F.col(f"{prefix}params"), name)]
    if name in FIELDS:
        found.append(F.col(f"{prefix}{name}").cast("string"))
    return F.coalesce(*found)


def _side(text: str, static: bool) -> Column:
    return P.clean(F.lit(text) if static else F.coalesce(operand(text), F.lit("")))


def holds(alias: Alias) -> Column:
    """Whether an event can fill an alias: its type, with case, and all conditions; null is an empty text."""
    ok = F.col("eventType") == alias.event
    for c in alias.conditions:
        ok = ok & P.compare(c.operator, _side(c.first, c.first_static), _side(c.second, c.second_static))
    return F.coalesce(ok, F.lit(False))


def _rules(d: Definition) -> Column:
    """Whether all rules hold between the aliases' columns; a null or an unknown alias makes a rule false."""
    known = {a.alias: i for i, a in enumerate(d.aliases)}
    ok = F.lit(True)
    for r in d.rules:
        if r.first not in known or r.second not in known:
            return F.lit(False)
        ok = ok & F.coalesce(P.compare(r.operator, operand(r.first_property, f"e{known[r.first]}."), operand(r.second_property, f"e{known[r.second]}.")), F.lit(False))
    return ok


def _result(rows: DataFrame, d: Definition) -> DataFrame:
    """One business event a row of alias columns e0, e1, ...: the first alias gives all but type and parameters."""
    known = {a.alias: i for i, a in enumerate(d.aliases)}
    # the last of several of one name counts
    cells = [c for p in {p.as_name: p for p in d.params}.values() for c in (F.lit(p.as_name), F.coalesce(operand(p.name, f"e{known[p.alias]}.") if p.alias in known else F.lit(None).cast("string"), F.lit("")))]
    params = F.create_map(*cells) if cells else F.create_map().cast("map<string,string>")
    ident = event_id(F.col("e0.txId"), F.col("e0.clauseIndex"), F.col("e0.seq.item"), F.lit(d.name), F.col("e0.id"))
    own = {"id": ident, "params": params, "eventType": F.lit(d.name), "raw": F.lit(None), "address": F.lit(None), "signature": F.lit(None)}
    return rows.select(*[own.get(f.name, F.col(f"e0.{f.name}")).cast(f.dataType).alias(f.name) for f in INDEXED_EVENT])


def _group(d: Definition) -> list[str]:
    return ["blockNumber", "txId"] + (["clauseIndex"] if d.same_clause else [])


def single(events: DataFrame, d: Definition) -> DataFrame:
    """Matches of a definition of one alias: every event that fits, up to the first that breaks a rule."""
    rows = events.where(holds(d.aliases[0]))
    rows = rows.select(F.struct(*[F.col(c) for c in events.columns]).alias("e0"))
    if not d.rules:
        return _result(rows, d)
    return _result(_until_broken(rows.withColumn("k", F.row_number().over(Window.partitionBy(*[f"e0.{c}" for c in _group(d)]).orderBy("e0.seq"))), d), d)


def _until_broken(rows: DataFrame, d: Definition) -> DataFrame:
    """The ranks of a group before the first one whose rules fail."""
    group = Window.partitionBy(*[f"e0.{c}" for c in _group(d)])
    good = rows.withColumn("ok", _rules(d))
    return good.withColumn("broken", F.min(F.when(~F.col("ok"), F.col("k"))).over(group)).where("broken IS NULL OR k < broken").drop("ok", "broken")


def ranked(events: DataFrame, d: Definition) -> DataFrame:
    """Matches of a definition whose aliases have different event types."""
    keys = _group(d)
    parts = []
    for i, a in enumerate(d.aliases):
        rows = events.where(holds(a))
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("seq")))
        parts.append(rows.select(*[F.col(c).alias(f"g_{c}") for c in keys], "k", F.struct(*[F.col(c) for c in events.columns]).alias(f"e{i}")))
    rows = reduce(lambda x, y: x.join(y, [f"g_{c}" for c in keys] + ["k"]), parts)
    return _result(_until_broken(rows, d) if d.rules else rows, d)


# The matching loop over one transaction


def _number(x: str) -> Decimal | None:
    if not re.match(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", x):
        return None
    try:
        return Decimal(x)
    except InvalidOperation:
        return None


def _compare(operator: str, a: str, b: str) -> bool:
    if operator == "EQ":
        return a.lower() == b.lower()
    if operator == "NE":
        return a != b
    x, y = _number(a), _number(b)
    if x is None or y is None:
        x, y = a, b
    return {"GT": x > y, "LT": x < y, "GE": x >= y, "LE": x <= y}[operator]


def _find(e: dict, name: str) -> str | None:
    got = e["params"].get(name)
    if got is None and name in FIELDS:
        got = e[name]
    return None if got is None else str(got)


def _fits(e: dict, a: Alias) -> bool:
    if e["eventType"] != a.event:
        return False
    for c in a.conditions:
        x, y = ((t if static else _find(e, t) or "").strip().lower() for t, static in ((c.first, c.first_static), (c.second, c.second_static)))
        if not _compare(c.operator, x, y):
            return False
    return True


def _keeps(d: Definition, found: dict[str, dict]) -> bool:
    for r in d.rules:
        if r.first not in found or r.second not in found:
            return False
        x, y = _find(found[r.first], r.first_property), _find(found[r.second], r.second_property)
        if x is None or y is None or not _compare(r.operator, x, y):
            return False
    return True


def _greedy(d: Definition, pool: Sequence[dict]) -> dict[str, dict] | None:
    """The first fitting event for each alias in turn, none twice."""
    found: dict[str, dict] = {}
    used: set[str] = set()
    for a in d.aliases:
        e = next((e for e in pool if e["id"] not in used and _fits(e, a)), None)
        if e is None:
            return None
        found[a.alias] = e
        used.add(e["id"])
    # of two aliases of one name the later takes the place of the earlier: never complete
    return found if found and len(found) == len(d.aliases) and _keeps(d, found) else None


def _exhaustive(d: Definition, pool: Sequence[dict]) -> dict[str, dict] | None:
    """The first complete assignment by type whose rules hold, depth first, within ``max_attempts`` nodes. Conditions don't count here."""
    complete: list[dict[str, dict]] = []
    left = d.max_attempts

    def go(i: int, found: dict[str, dict], used: frozenset[str]) -> None:
        nonlocal left
        if left <= 0:
            return
        left -= 1
        if i == len(d.aliases):
            if found:
                complete.append(found)
            return
        for e in pool:
            if e["eventType"] == d.aliases[i].event and e["id"] not in used:
                go(i + 1, {**found, d.aliases[i].alias: e}, used | {e["id"]})

    go(0, {}, frozenset())
    return next((f for f in complete if _keeps(d, f)), None)


def match(events: Sequence[dict], definitions: Sequence[Definition]) -> list[tuple[Definition, dict[str, dict]]]:
    """All matches in one transaction's events, given in order."""
    pool, out = list(events), []
    for d in definitions:
        if not pool:
            break
        parts: dict = {}
        for e in pool:
            parts.setdefault(e["clauseIndex"] if d.same_clause else None, []).append(e)
        for part in parts.values():
            while part:
                found = (_exhaustive if d.every_combination else _greedy)(d, part)
                if not found:
                    break
                gone = {e["id"] for e in found.values()}
                part = [e for e in part if e["id"] not in gone]
                pool = [e for e in pool if e["id"] not in gone]
                out.append((d, found))
    return out


#: What a match keeps of the event that fills its first alias.
_KEPT = ("blockId", "blockNumber", "blockTimestamp", "txId", "origin", "paid", "gasUsed", "gasPayer", "clauseIndex", "seq")
_MATCH = ", ".join(f"{c} {INDEXED_EVENT[c].dataType.simpleString()}" for c in _KEPT) + ", id string, eventType string, params map<string, string>"


def _loop(definitions: Sequence[Definition]):
    """Rows come sorted by transaction; the last transaction of a batch waits for the next one."""

    def found(rows: list[dict]) -> Iterator[dict]:
        for r in rows:
            r["params"] = dict(r["params"] or ())
        for d, f in match(rows, definitions):
            first = f[d.aliases[0].alias]
            params = {p.as_name: f[p.alias]["params"].get(p.name) or _find(f[p.alias], p.name) or "" if p.alias in f else "" for p in d.params}
            yield {c: first[c] for c in _KEPT} | {"id": first["id"], "eventType": d.name, "params": list(params.items())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, key = None, [], None
        for batch in batches:
            if schema is None:
                kinds = {f.name: f.type for f in batch.schema}
                schema = pa.schema([(c, kinds[c]) for c in _KEPT] + [("id", pa.string()), ("eventType", pa.string()), ("params", pa.map_(pa.string(), pa.string()))])
            out = []
            for r in batch.to_pylist():
                if (own := (r["blockNumber"], r["txId"])) != key:
                    out += found(held)
                    held, key = [], own
                held.append(r)
            yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist(list(found(held)), schema)

    return run


def general(events: DataFrame, definitions: Sequence[Definition]) -> DataFrame:
    """Matches of any definitions, a transaction at a time, only where every type of some definition is there."""
    definitions = list(definitions)
    keys = ["blockNumber", "txId"]
    types = sorted({a.event for d in definitions for a in d.aliases})
    some = events.where(F.col("eventType").isin(types)).select(*_KEPT, *[c for c in (*FIELDS, "params") if c not in _KEPT])
    there = Window.partitionBy(*keys)
    enough = reduce(lambda x, y: x | y, [reduce(lambda x, y: x & y, [F.max(F.col("eventType") == t).over(there) for t in sorted({a.event for a in d.aliases})]) for d in definitions if d.aliases], F.lit(False))
    # one shuffle and one sort serve the test for the types and the loop
    some = some.repartition(*keys).sortWithinPartitions(*keys, "seq", "id").withColumn("_enough", enough).where("_enough").drop("_enough")
    rows = some.sortWithinPartitions(*keys, "seq", "id").mapInArrow(_loop(definitions), _MATCH)
    ident = event_id(F.col("txId"), F.col("clauseIndex"), F.col("seq.item"), F.col("eventType"), F.col("id"))
    return rows.select(*[(ident if f.name == "id" else F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in INDEXED_EVENT])


def plan(definitions: Sequence[Definition]) -> list[tuple[str, list[Definition]]]:
    """Which strategy each definition gets. Definitions that share event types go together, in order."""
    groups: list[list[Definition]] = []
    for d in definitions:
        types = {a.event for a in d.aliases}
        shared = [g for g in groups if any(types & {a.event for a in o.aliases} for o in g)]
        groups = [g for g in groups if g not in shared] + [[o for g in shared for o in g] + [d]]
    out = []
    for g in groups:
        g = sorted(g, key=list(definitions).index)
        d = g[0]
        types, names = [a.event for a in d.aliases], [a.alias for a in d.aliases]
        if not d.aliases or len(set(names)) < len(names):
            kind = "general" if len(g) > 1 else "none"
        elif len(g) > 1 or d.every_combination or len(set(types)) < len(types):
            kind = "general"
        else:
            kind = "single" if len(types) == 1 else "ranked"
        out.append((kind, g))
    return out


def business_events(events: DataFrame, definitions: Sequence[Definition]) -> DataFrame:
    """Business events of decoded events."""
    parts = []
    for kind, group in plan(definitions):
        if kind == "general":
            parts.append(general(events, group))
        elif kind != "none":
            parts.append((single if kind == "single" else ranked)(events, group[0]))
    return reduce(DataFrame.unionByName, parts) if parts else events.limit(0)
