"""From blocks and logs to indexed events: one scan, filtered before it is decoded."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import words as W
from tidemark.schemas import INDEXED_EVENT, TRANSFER

from .decode import event_params
from .registry import Abi, first_of_each



def _topic0(topics: Column) -> Column:
    return F.lower(W.strip0x(F.get(topics, F.lit(0))))


def is_valid(topics: Column, address: Column, abis: Iterable[Abi], contracts: Sequence[str] = ()) -> Column:
    """Topics are there, topic 0 is in the registry, and the address, if any are asked for, is one of them without case."""
    signatures = sorted({a.signature for a in abis if a.signature})
    ok = (F.size(topics) > 0) & _topic0(topics).isin(signatures)
    if contracts:
        ok = ok & F.lower(address).isin(sorted({c.lower() for c in contracts}))
    return F.coalesce(ok, F.lit(False))


def matching(abis: Iterable[Abi]) -> list[Abi]:
    """The first entry of each topic 0 and number of topics."""
    out: dict[tuple, Abi] = {}
    for a in abis:
        if a.signature:
            out.setdefault((a.signature, a.n_topics), a)
    return list(out.values())


def _fits(abis: Sequence[Abi], n_topics: Column, topic0: Column) -> Column:
    """Whether a row with so many topics and this first one fits one of the entries."""
    counts: dict[int, list[str]] = {}
    for a in abis:
        counts.setdefault(a.n_topics, []).append(a.signature)
    return reduce(or_, [(n_topics == n) & topic0.isin(signatures) for n, signatures in counts.items()], F.lit(False))


def _name(abis: Sequence[Abi]) -> Column:
    """The name of the entry that a row with bare topics fits, else null."""
    out = F.lit(None).cast("string")
    for a in reversed(abis):
        out = F.when((F.col("_t0") == a.signature) & (F.col("_n") == a.n_topics), F.lit(a.name)).otherwise(out)
    return out


def _params(abis: Sequence[Abi], topics: Column, data: Column, bare: Sequence[Column]) -> Column:
    """The parameters of a row that fits one of the entries. Entries of one layout share one decoder."""
    layouts: dict[tuple, list[Abi]] = {}
    for a in abis:
        layouts.setdefault(a.inputs, []).append(a)
    *some, last = layouts.values()
    out = event_params(last[0], topics, data, bare)
    for own in reversed(some):
        out = F.when(_fits(own, F.col("_n"), F.col("_t0")), event_params(own[0], topics, data, bare)).otherwise(out)
    return out


#: A log has four topics at most; the next one is for registries that say otherwise.
_TOPICS = 5


def event_id(tx: Column, clause: Column, item: Column, *rest: Column) -> Column:
    """txId-clause-item-hash, the same in every mode and batch."""
    return F.concat_ws("-", tx, clause.cast("string"), item.cast("string"), F.lower(F.hex(F.xxhash64(*rest))))


def filter_contracts(logs: DataFrame, contracts: DataFrame, column: str = "address") -> DataFrame:
    """Rows of any of very many contracts (a table with ``address``), without case."""
    wanted = contracts.select(F.lower("address").alias("_address")).distinct()
    return logs.join(wanted, F.lower(logs[column]) == F.col("_address"), "left_semi")


def flatten(blocks: DataFrame) -> DataFrame:
    """A row for each output of each transaction, with the ordinals of both."""
    tx = blocks.select(F.col("id").alias("blockId"), F.col("number").alias("blockNumber"), F.col("timestamp").alias("blockTimestamp"), F.posexplode("transactions").alias("txIndex", "tx"))
    return tx.select("blockId", "blockNumber", "blockTimestamp", "txIndex", *[F.col(f"tx.{c}").alias(n) for c, n in (("id", "txId"), ("origin", "origin"), ("paid", "paid"), ("gasUsed", "gasUsed"), ("gasPayer", "gasPayer"))], F.posexplode("tx.outputs").alias("clauseIndex", "output"))


def block_events(blocks: DataFrame) -> DataFrame:
    """Undecoded events of blocks, one a row, in the shape that ``decode`` takes."""
    flat = flatten(blocks).select("*", F.posexplode("output.events").alias("item", "event")).drop("output")
    return flat.select("*", "event.address", "event.topics", "event.data").drop("event")


def log_events(logs: DataFrame) -> DataFrame:
    """Undecoded events of a log scan. ``logIndex`` and ``txIndex`` order them if there, else a stable hash does."""
    place = F.col("logIndex").cast("bigint") if "logIndex" in logs.columns else F.xxhash64("address", "topics", "data")
    tx = F.col("txIndex").cast("int") if "txIndex" in logs.columns else F.lit(0)
    none = F.lit(None)
    return logs.select(
        F.col("meta.blockID").alias("blockId"), F.col("meta.blockNumber").alias("blockNumber"), F.col("meta.blockTimestamp").alias("blockTimestamp"), tx.alias("txIndex"),
        F.col("meta.txID").alias("txId"), F.col("meta.txOrigin").alias("origin"), none.cast("string").alias("paid"), none.cast("bigint").alias("gasUsed"), none.cast("string").alias("gasPayer"),
        F.col("meta.clauseIndex").alias("clauseIndex"), place.alias("item"), "address", "topics", "data",
    )


def _event(df: DataFrame, kind: int, **cells: Column) -> DataFrame:
    seq = F.struct(F.col("blockNumber").cast("bigint").alias("block"), F.col("txIndex").cast("bigint").alias("tx"), F.col("clauseIndex").cast("bigint").alias("clause"), F.lit(kind).alias("kind"), F.col("item").cast("bigint").alias("item"))
    own = cells | {"seq": seq}
    return df.select(*[own.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in INDEXED_EVENT])


def decode(rows: DataFrame, abis: Sequence[Abi], contracts: Sequence[str] = ()) -> DataFrame:
    """Indexed events of undecoded rows that an entry of the registry fits; the others are left out."""
    abis = matching(abis)
    topics = F.col("topics")
    # one test of each row: the entry's topic and number of topics, and the address
    wanted = _fits(abis, F.size(topics), _topic0(topics))
    if contracts:
        wanted = wanted & F.lower("address").isin(sorted({c.lower() for c in contracts}))
    rows = rows.where(wanted)
    # computed once a row, below the many places that read them
    rows = rows.withColumns({"_n": F.size(topics), "_t0": _topic0(topics), "_data": W.strip0x(F.coalesce("data", F.lit("")))} | {f"_t{i}": W.strip0x(F.get(topics, F.lit(i))) for i in range(1, _TOPICS)})
    rows = rows.withColumn("_name", _name(abis))
    bare = [F.col(f"_t{i}") for i in range(_TOPICS)]
    params = _params(abis, topics, F.col("_data"), bare) if abis else F.lit(None).cast("map<string,string>")
    ident = event_id(F.col("txId"), F.col("clauseIndex"), F.col("item"), F.col("address"), topics, F.col("data"))
    return _event(rows, 0, id=ident, eventType=F.col("_name"), params=params, raw=F.struct("data", "topics"), signature=F.col("_t0"))


def match_registry(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows with the ordinal, name and uid of the first entry of a registry table that fits them.

    The registry has a row for each ABI entry; joined on topic 0 and the number of topics.
    """
    first = first_of_each(registry, ["topic0", "n_topics"]).select("topic0", "n_topics", "ordinal", "name", "uid")
    return rows.withColumns({"topic0": _topic0(F.col("topics")), "n_topics": F.size("topics")}).join(first, ["topic0", "n_topics"])


def _transfers(rows: DataFrame) -> DataFrame:
    amount = W.quantity(F.col("amount"))
    rows = rows.withColumn("_amount", amount).where("_amount IS NOT NULL")
    params = F.create_map(F.lit("from"), F.col("sender"), F.lit("to"), F.col("recipient"), F.lit("amount"), F.col("_amount"))
    ident = event_id(F.col("txId"), F.col("clauseIndex"), F.col("item"), F.col("sender"), F.col("recipient"), F.col("amount"))
    return _event(rows, 1, id=ident, eventType=F.lit(TRANSFER), params=params)


def block_transfers(blocks: DataFrame) -> DataFrame:
    """Native transfers of blocks as events; a transfer whose amount isn't hex is left out."""
    flat = flatten(blocks).select("*", F.posexplode("output.transfers").alias("item", "t")).drop("output")
    return _transfers(flat.select("*", "t.sender", "t.recipient", "t.amount").drop("t"))


def log_transfers(logs: DataFrame) -> DataFrame:
    """Native transfers of a log scan as events."""
    place = F.col("logIndex").cast("bigint") if "logIndex" in logs.columns else F.xxhash64("sender", "recipient", "amount")
    tx = F.col("txIndex").cast("int") if "txIndex" in logs.columns else F.lit(0)
    none = F.lit(None)
    return _transfers(logs.select(
        F.col("meta.blockID").alias("blockId"), F.col("meta.blockNumber").alias("blockNumber"), F.col("meta.blockTimestamp").alias("blockTimestamp"), tx.alias("txIndex"),
        F.col("meta.txID").alias("txId"), F.col("meta.txOrigin").alias("origin"), none.cast("string").alias("paid"), none.cast("bigint").alias("gasUsed"), none.cast("string").alias("gasPayer"),
        F.col("meta.clauseIndex").alias("clauseIndex"), place.alias("item"), "sender", "recipient", "amount",
    ))


def in_order(events: DataFrame, mode: str = "log") -> DataFrame:
    """Log mode: by kind within a block range; block mode: by clause, then kind."""
    s = "seq."
    keys = [s + "block", s + "tx", s + "clause", s + "kind", s + "item"] if mode == "block" else [s + "kind", s + "block", s + "tx", s + "clause", s + "item"]
    return events.orderBy(*keys)
