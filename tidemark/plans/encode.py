"""Plain tables as chain data: their rows encoded to logs, transfers and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import words as W
from tidemark.operators.registry import Abi, Param


def _abi(name: str, *params: tuple[str, str, bool]) -> Abi:
    return Abi(name, "event", tuple(Param(n, t, i) for n, t, i in params))


_ITEM = (("supplier", "address", True), ("part", "address", True), ("quantity", "uint256", False), ("price", "uint256", False))
RETURNED, ACCEPTED, NOTED = (_abi(n, *_ITEM) for n in ("Returned", "Accepted", "Noted"))
#: The event of each return flag.
ITEM_ABIS = {"R": RETURNED, "A": ACCEPTED, "N": NOTED}
ABIS = tuple(ITEM_ABIS.values())

#: The event of ``event_blocks``.
SIZED = _abi("Sized", ("size", "uint256", False))

#: Contract addresses are the supplier's key modulo this.
CONTRACTS = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x: Column) -> Column:
    return F.round(x * 100).cast("bigint")


def payload(*words: Column) -> Column:
    return F.concat(F.lit("0x"), *words)


def meta(block: Column, tx: Column, origin: Column, clause: Column, time: Column | None = None) -> Column:
    return F.struct(
        F.concat(F.lit("b"), block.cast("string")).alias("blockID"), block.cast("bigint").alias("blockNumber"), (time if time is not None else block * 10).cast("bigint").alias("blockTimestamp"),
        tx.cast("string").alias("txID"), origin.alias("txOrigin"), clause.cast("int").alias("clauseIndex"),
    )


#: Order of line items within a clause; ties after it are equal rows.
TIES = ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")


def item_logs(lines: DataFrame, ordered: bool = False) -> DataFrame:
    """Line items as event logs: an order is a transaction, ten orders a block, a line number a clause."""
    topic0 = F.lit(None).cast("string")
    for flag, abi in ITEM_ABIS.items():
        topic0 = F.when(F.col("l_returnflag") == flag, F.lit("0x" + abi.signature)).otherwise(topic0)
    word = lambda c: payload(W.encode_uint(F.col(c)))
    logs = lines.select(
        W.encode_address(F.col("l_suppkey") % CONTRACTS).alias("address"),
        F.array(topic0, word("l_suppkey"), word("l_partkey")).alias("topics"),
        payload(W.encode_uint(F.col("l_quantity")), W.encode_uint(cents(F.col("l_extendedprice")))).alias("data"),
        meta(F.floor(F.col("l_orderkey") / 10), F.col("l_orderkey"), W.encode_address(F.col("l_suppkey")), F.col("l_linenumber")).alias("meta"),
        *([F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*TIES)).alias("logIndex"), F.col("l_orderkey").alias("txIndex")] if ordered else []),
    )
    return logs


def order_transfers(orders: DataFrame) -> DataFrame:
    """Orders as native transfers of their price in cents from the customer to one account."""
    return orders.select(
        W.encode_address(F.col("o_custkey")).alias("sender"), W.encode_address(F.lit(255)).alias("recipient"),
        F.concat(F.lit("0x"), F.lower(F.hex(cents(F.col("o_totalprice"))))).alias("amount"),
        meta(F.floor(F.col("o_orderkey") / 10), F.col("o_orderkey"), W.encode_address(F.col("o_custkey")), F.lit(0)).alias("meta"),
        F.lit(0).alias("logIndex"), F.col("o_orderkey").alias("txIndex"),
    )


def event_blocks(events: DataFrame, topic0: str | None = None) -> DataFrame:
    """Events as blocks of ten seconds: a user is a transaction, each event an output of its own. Topic 0 is the event's id, if no other is given."""
    number = F.floor(F.unix_timestamp("ts") / 10)
    amount = F.concat(F.lit("0x"), F.lower(F.hex(cents(F.abs("value")))))
    output = F.struct(
        F.col("ts"), F.col("event_id"), F.lit(None).cast("string").alias("contractAddress"),
        F.array(F.struct(W.encode_address(F.col("user_id")).alias("address"), F.array(F.lit("0x" + topic0) if topic0 else payload(W.encode_uint(F.col("event_id")))).alias("topics"), payload(W.encode_uint(F.length("event_type"))).alias("data"))).alias("events"),
        F.array(F.struct(W.encode_address(F.col("user_id")).alias("sender"), W.encode_address(F.lit(1)).alias("recipient"), amount.alias("amount"))).alias("transfers"),
    )
    tx = events.select(number.alias("number"), "user_id", output.alias("o")).groupBy("number", "user_id").agg(F.sort_array(F.collect_list("o")).alias("o"))
    outputs = F.transform("o", lambda x: F.struct(x["contractAddress"].alias("contractAddress"), x["events"].alias("events"), x["transfers"].alias("transfers")))
    cells = F.struct(
        F.col("user_id"), F.concat_ws(":", F.col("number").cast("string"), F.col("user_id").cast("string")).alias("id"), W.encode_address(F.col("user_id")).alias("origin"),
        F.lit("0x1").alias("paid"), F.lit(21000).cast("bigint").alias("gasUsed"), W.encode_address(F.col("user_id")).alias("gasPayer"), outputs.alias("outputs"),
    )
    blocks = tx.select("number", cells.alias("t")).groupBy("number").agg(F.sort_array(F.collect_list("t")).alias("transactions"))
    return blocks.select("number", F.concat(F.lit("b"), F.col("number").cast("string")).alias("id"), (F.col("number") * 10).alias("timestamp"), "transactions")


def block_heads(events: DataFrame) -> DataFrame:
    """Numbers and ids of the blocks, with a parent that is wrong where the number divides by 97."""
    heads = events.select(F.floor(F.unix_timestamp("ts") / 10).alias("number")).distinct()
    before = F.lag("number").over(Window.partitionBy(F.floor(F.col("number") / 100_000)).orderBy("number"))
    parent = F.when(F.col("number") % 97 == 0, F.lit("fork")).otherwise(F.concat(F.lit("b"), F.coalesce(before, F.col("number") - 1).cast("string")))
    return heads.select("number", F.concat(F.lit("b"), F.col("number").cast("string")).alias("id"), parent.alias("parentID"), (F.col("number") * 10).alias("timestamp"))
