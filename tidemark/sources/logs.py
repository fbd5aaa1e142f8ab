"""Range scans over log tables: criteria, block ranges and pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EventCriteria:
    address: str | None = None
    topic0: str | None = None
    topic1: str | None = None
    topic2: str | None = None
    topic3: str | None = None
    topic4: str | None = None

    def column(self) -> Column:
        """All parts that are given hold, without case."""
        parts = [F.lower("address") == self.address.lower()] if self.address else []
        for i in range(5):
            if t := getattr(self, f"topic{i}"):
                parts.append(F.lower(F.get("topics", F.lit(i))) == t.lower())
        return reduce(lambda x, y: x & y, parts, F.lit(True))


@dataclass(frozen=True)
class TransferCriteria:
    txOrigin: str | None = None
    sender: str | None = None
    recipient: str | None = None

    def column(self) -> Column:
        of = {"txOrigin": "meta.txOrigin", "sender": "sender", "recipient": "recipient"}
        parts = [F.lower(of[k]) == v.lower() for k, v in asdict(self).items() if v]
        return reduce(lambda x, y: x & y, parts, F.lit(True))


def scan(logs: DataFrame, first: int, last: int, criteria: Sequence[EventCriteria | TransferCriteria] = ()) -> DataFrame:
    """Logs of a block range that meet one of the criteria; none given means all. The range reaches the file scan."""
    out = logs.where(F.col("meta.blockNumber").between(first, last))
    return out.where(F.coalesce(reduce(lambda x, y: x | y, [c.column() for c in criteria]), F.lit(False))) if criteria else out


def page(logs: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """One page of an ordered scan."""
    return logs.orderBy(*order).offset(offset).limit(limit)
