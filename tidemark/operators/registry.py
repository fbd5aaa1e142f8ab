"""The ABI registry: events and functions from JSON, with signatures, filters and de-duplication."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.keccak import signature
from tidemark.sources import files


@dataclass(frozen=True)
class Param:
    name: str
    type: str
    indexed: bool = False
    components: tuple[Param, ...] = ()

    @classmethod
    def of(cls, x: Mapping) -> Param:
        return cls(x.get("name") or "", x["type"], bool(x.get("indexed")), tuple(map(cls.of, x.get("components") or ())))

    @property
    def canonical(self) -> str:
        """The type with tuples written out, at any depth and in arrays."""
        if self.type.startswith("tuple"):
            return "(" + ",".join(c.canonical for c in self.components) + ")" + self.type[5:]
        return re.sub(r"^(u?int)(?=$|\[)", r"\g<1>256", self.type)


@dataclass(frozen=True)
class Abi:
    name: str
    type: str = "event"
    inputs: tuple[Param, ...] = ()
    outputs: tuple[Param, ...] = ()
    anonymous: bool = False

    @classmethod
    def of(cls, x: Mapping) -> Abi:
        """From an entry of an ABI file; a ``signature`` in it is ignored."""
        return cls(x.get("name") or "", x.get("type") or "", tuple(map(Param.of, x.get("inputs") or ())), tuple(map(Param.of, x.get("outputs") or ())), bool(x.get("anonymous")))

    @property
    def canonical(self) -> str:
        return f"{self.name}({','.join(p.canonical for p in self.inputs)})"

    @cached_property
    def signature(self) -> str | None:
        return signature(self.canonical) if self.name else None

    @property
    def n_topics(self) -> int:
        return 1 + sum(p.indexed for p in self.inputs)

    @property
    def uid(self) -> str:
        """What makes an entry a duplicate: name, types and which of them are indexed."""
        return f"{self.name}({','.join(('indexed ' if p.indexed else '') + p.type for p in self.inputs)})"


def distinct(entries: Iterable[Abi]) -> list[Abi]:
    out: dict[str, Abi] = {}
    for e in entries:
        out.setdefault(e.uid, e)
    return list(out.values())


def select(entries: Iterable[Abi], kind: str, names: Iterable[str] = ()) -> list[Abi]:
    """Distinct entries of a kind. Names match without case; none means all; one that matches nothing is an error."""
    own = [e for e in entries if e.type == kind]
    wanted = {n.lower() for n in names}
    if wanted:
        missing = wanted - {e.name.lower() for e in own}
        if missing:
            raise ValueError(f"no {kind} named: {', '.join(sorted(missing))}")
        own = [e for e in own if e.name.lower() in wanted]
    return distinct(own)


def load(base: str | Path, kind: str = "event", names: Iterable[str] = (), values: Mapping[str, str] | None = None) -> list[Abi]:
    """Entries of all JSON files below a folder, in order of path and place."""
    return select(map(Abi.of, files.load_all(files.find(base, ".json"), values)), kind, names)


def frame(spark: SparkSession, entries: Iterable[Abi]) -> DataFrame:
    """The registry as a table: ordinal, name, topic0, n_topics, uid."""
    rows = [(i, e.name, e.signature, e.n_topics, e.uid) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, "ordinal int, name string, topic0 string, n_topics int, uid string")


def first_of_each(entries: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """The rows of a table that come first of their keys."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return entries.withColumn("_turn", turn).where("_turn = 1").drop("_turn")
