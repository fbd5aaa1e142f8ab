"""One event table from decoded events and business events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import TRANSFER

from . import business, events
from .registry import Abi


@dataclass(frozen=True)
class Criteria:
    """What a consumer wants to see of an event table; empty lists mean everything."""

    events: tuple[str, ...] = ()
    business_events: tuple[str, ...] = ()
    contracts: tuple[str, ...] = ()
    transfers: bool = False
    remove_duplicates: bool = True

    @property
    def names(self) -> list[str]:
        """Event types of both kinds, each once."""
        return list(dict.fromkeys((*self.events, *self.business_events)))

    def apply(self, table: DataFrame) -> DataFrame:
        """Rows of the wanted types and contracts; transfers and business events have no contract."""
        kind = F.col("eventType")
        ok = kind.isin(self.names) if self.names else F.lit(True)
        ok = (kind == TRANSFER) & F.lit(self.transfers) | (kind != TRANSFER) & ok
        if self.contracts:
            ok = ok & (F.col("address").isNull() | F.lower("address").isin([c.lower() for c in self.contracts]))
        return table.where(ok)


def without_used(abi_events: DataFrame, business_events: DataFrame) -> DataFrame:
    """Events of no transaction and clause that has a business event, and the business events."""
    keys = ["txId", "clauseIndex"]
    return abi_events.join(business_events.select(*keys).distinct(), keys, "left_anti").unionByName(business_events)


def process(rows: DataFrame | None, transfers: DataFrame | None, abis: Sequence[Abi] = (), definitions: Sequence[business.Definition] = (), contracts: Sequence[str] = (), include_transfers: bool = False, remove_duplicates: bool = True) -> DataFrame | None:
    """Decode once, match, and combine. None if nothing is asked for.

    ``rows`` are undecoded events, ``transfers`` decoded transfers. What no part
    asks for is not scanned.
    """
    with_transfers = transfers is not None and (include_transfers or business.needs_transfers(definitions))
    decoded = events.decode(rows, abis, contracts) if rows is not None and abis else None
    every = decoded
    if with_transfers:
        every = transfers if decoded is None else decoded.unionByName(transfers)
    if every is None:
        return None
    if not definitions:
        return every
    found = business.business_events(every, definitions)
    if not (abis or include_transfers):
        return found
    shown = every if include_transfers or decoded is None else decoded
    return without_used(shown, found) if remove_duplicates else shown.unionByName(found)
