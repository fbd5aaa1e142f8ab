"""The registered queries of the engine, each with the SQL that gives the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import params as P
from tidemark.functions import words as W
from tidemark.operators import business, chain, combine, decode, events, registry, schedule
from tidemark.operators.business import Alias, Condition, Definition, Rule, Taken
from tidemark.operators.registry import Abi, Param
from tidemark.session import shared_folder, ship
from tidemark.sources import logs as scans
from tidemark.sources import revision
from tidemark.sources.chain import register

from . import encode as E
from .encode import table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _address(x: str) -> str:
    return f"'0x' || lpad(lower(to_hex(({x})::BIGINT)), 40, '0')"


def _cents(x: str) -> str:
    return f"round({x} * 100)::BIGINT"


_KIND = "CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Accepted' ELSE 'Noted' END"
_ITEMS = f"""items AS (
  SELECT l_orderkey, l_linenumber, l_orderkey // 10 AS block, {_KIND} AS kind, {_address("l_suppkey")} AS supplier, {_address("l_partkey")} AS part,
         l_quantity::BIGINT AS quantity, {_cents("l_extendedprice")} AS price, {_address("l_suppkey % 7")} AS contract,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(E.TIES)}) AS item
  FROM lineitem)"""


def _logs(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    return E.item_logs(table(spark, sf_dir, "lineitem"), ordered)


def _decoded(spark: SparkSession, sf_dir: str, ordered: bool = True, abis=E.ABIS, contracts=()) -> DataFrame:
    return events.decode(events.log_events(_logs(spark, sf_dir, ordered)), abis, contracts)


def _shown(e: DataFrame, *more: Column) -> DataFrame:
    """Decoded line items with their parameters as columns."""
    p = lambda n: P.get(F.col("params"), n)
    return e.select(F.col("blockNumber").alias("block"), F.col("txId").alias("tx"), F.col("clauseIndex").alias("clause"), F.col("eventType").alias("kind"), "address", p("supplier").alias("supplier"), p("part").alias("part"), P.as_long(p("quantity")).alias("quantity"), P.as_long(p("price")).alias("price"), *more)


_SHOWN = "block, l_orderkey::VARCHAR AS tx, l_linenumber::BIGINT AS clause, kind, contract AS address, supplier, part, quantity, price"


@query(f"WITH {_ITEMS} SELECT {_SHOWN} FROM items")
def indexed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs filtered, matched with the registry and decoded in one pass."""
    return _shown(_decoded(spark, sf_dir, False))


@query(f"SELECT l_orderkey, {_address('l_suppkey')} AS supplier, {_address('l_partkey')} AS part, l_quantity::BIGINT AS quantity, {_cents('l_extendedprice')} AS price FROM lineitem")
def abi_decode_uint_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logs(spark, sf_dir)
    cols = decode.typed_view(E.RETURNED, F.col("topics"), W.strip0x(F.col("data")))
    return rows.select(F.col("meta.txID").cast("bigint").alias("l_orderkey"), *cols).withColumns({c: F.col(c).cast("bigint") for c in ("quantity", "price")})


@query("SELECT doc_id, text, n_chars FROM documents")
def abi_decode_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as a dynamic string before a number."""
    docs = table(spark, sf_dir, "documents")
    data = F.concat(W.encode_uint(F.lit(64)), W.encode_uint(F.col("n_chars")), W.encode_string(F.coalesce("text", F.lit(""))))
    rows = docs.select("doc_id", data.alias("data"))
    out = rows.select("doc_id", *decode.typed([Param("text", "string"), Param("n_chars", "uint256")], F.col("data")))
    return out.withColumn("n_chars", F.col("n_chars").cast("bigint"))


@query("SELECT l_orderkey, (i - 1)::BIGINT AS place, parts[i] AS part FROM (SELECT l_orderkey, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT l_orderkey, list(l_partkey ORDER BY l_partkey) AS parts FROM lineitem GROUP BY l_orderkey))")
def abi_decode_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each order as uint256[]."""
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("parts"))
    data = F.concat(W.encode_uint(F.lit(32)), W.encode_uint(F.size("parts")), F.array_join(F.transform("parts", W.encode_uint), ""))
    rows = own.select("l_orderkey", data.alias("data"))
    out = rows.select("l_orderkey", *decode.typed([Param("parts", "uint256[]")], F.col("data")))
    return out.select("l_orderkey", F.posexplode("parts").alias("place", "part")).select("l_orderkey", F.col("place").cast("bigint").alias("place"), F.col("part").cast("bigint").alias("part"))


@query("SELECT c_custkey, c_nationkey::BIGINT AS nation, c_custkey % 9 AS code, c_name AS name, c_mktsegment AS segment, c_custkey * 3 AS last FROM customer")
def abi_decode_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A static tuple, a dynamic one, and a number after both."""
    c = table(spark, sf_dir, "customer")
    name, segment = W.encode_string(F.col("c_name")), W.encode_string(F.col("c_mktsegment"))
    body = F.concat(W.encode_uint(F.lit(64)), W.encode_uint(F.lit(64) + F.length(name) / 2), name, segment)
    data = F.concat(W.encode_uint(F.col("c_nationkey")), W.encode_uint(F.col("c_custkey") % 9), W.encode_uint(F.lit(128)), W.encode_uint(F.col("c_custkey") * 3), body)
    kinds = [Param("place", "tuple", components=(Param("nation", "uint16"), Param("code", "uint8"))), Param("words", "tuple", components=(Param("name", "string"), Param("segment", "string"))), Param("last", "uint256")]
    out = c.select("c_custkey", data.alias("data")).select("c_custkey", *decode.typed(kinds, F.col("data")))
    return out.select("c_custkey", F.col("place.nation").cast("bigint").alias("nation"), F.col("place.code").cast("bigint").alias("code"), "words.name", "words.segment", F.col("last").cast("bigint").alias("last"))


@query(f"SELECT c_custkey, {_cents('c_acctbal')} AS balance FROM customer")
def abi_decode_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", W.encode_int(E.cents(F.col("c_acctbal"))).alias("data"))
    return c.select("c_custkey", *decode.typed([Param("balance", "int128")], F.col("data"))).withColumn("balance", F.col("balance").cast("bigint"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_returnflag = 'R' AS back, '0x' || lower(hex(l_linestatus)) || '000000' AS mark FROM lineitem")
def abi_decode_bool_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    data = F.concat(W.encode_uint((F.col("l_returnflag") == "R").cast("int")), F.rpad(F.lower(F.hex(F.col("l_linestatus").cast("binary"))), 64, "0"))
    rows = li.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), data.alias("data"))
    return rows.select("l_orderkey", "l_linenumber", *decode.typed([Param("back", "bool"), Param("mark", "bytes4")], F.col("data")))


@query("SELECT l_orderkey, l_quantity::BIGINT::VARCHAR AS quantity, '0x' AS price FROM lineitem")
def abi_fallback_short_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word is missing: its parameter is 0x, and the event stays."""
    rows = events.log_events(_logs(spark, sf_dir)).withColumn("data", F.substring("data", 1, 66 + 10))
    e = events.decode(rows, E.ABIS)
    return e.select(F.col("txId").cast("bigint").alias("l_orderkey"), P.get(F.col("params"), "quantity").alias("quantity"), P.get(F.col("params"), "price").alias("price"))


@query(f"SELECT p_partkey, p_size::BIGINT AS size, p_name AS name, {_cents('p_retailprice')} AS price FROM part")
def function_return_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return data after a four-byte selector."""
    p = table(spark, sf_dir, "part")
    raw = F.concat(F.lit("0xa9059cbb"), W.encode_uint(F.col("p_size")), W.encode_uint(F.lit(96)), W.encode_uint(E.cents(F.col("p_retailprice"))), W.encode_string(F.col("p_name")))
    kinds = [Param("size", "uint8"), Param("name", "string"), Param("price", "uint256")]
    out = p.select("p_partkey", raw.alias("raw")).select("p_partkey", *decode.returns(kinds, F.col("raw")))
    return out.withColumns({"size": F.col("size").cast("bigint"), "price": F.col("price").cast("bigint")})


_FT = Abi("Moved", "event", (Param("from", "address", True), Param("to", "address", True), Param("value", "uint256")))
_NFT = Abi("Moved", "event", (Param("from", "address", True), Param("to", "address", True), Param("id", "uint256", True)))


@query("SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS entry, CASE WHEN l_linenumber % 2 = 0 THEN 'id' ELSE 'value' END AS param, l_partkey FROM lineitem")
def find_matching_abi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topic 0, two entries: the number of topics tells them apart."""
    word = lambda c: E.payload(W.encode_uint(F.col(c)))
    three = F.array(F.lit("0x" + _FT.signature), word("l_suppkey"), word("l_suppkey"))
    nft = F.col("l_linenumber") % 2 == 0
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(nft, F.concat(three, F.array(word("l_partkey")))).otherwise(three).alias("topics"), F.when(nft, F.lit("0x")).otherwise(word("l_partkey")).alias("data"))
    found = events.match_registry(rows, registry.frame(spark, [_FT, _NFT, _FT]))
    maps = [decode.event_params(a, F.col("topics"), W.strip0x(F.col("data"))) for a in (_FT, _NFT)]
    params = F.when(F.col("ordinal") == 0, maps[0]).otherwise(maps[1])
    out = found.select("l_orderkey", F.col("ordinal").cast("bigint").alias("entry"), params.alias("p"))
    name = F.when(F.col("entry") == 0, F.lit("value")).otherwise(F.lit("id"))
    return out.select("l_orderkey", "entry", name.alias("param"), P.as_long(F.try_element_at("p", name)).alias("l_partkey"))


@query(f"WITH {_ITEMS} SELECT {_SHOWN} FROM items WHERE contract IN ({_address('3')}, {_address('5')})")
def contract_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in any case."""
    some = ["0x" + "0" * 39 + "3", ("0x" + "0" * 39 + "5").upper().replace("0X", "0x")]
    return _shown(_decoded(spark, sf_dir, False, contracts=some))


@query(f"WITH {_ITEMS} SELECT {_SHOWN} FROM items WHERE contract IN ({_address('0')}, {_address('1')}, {_address('6')})")
def contract_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contracts as a table."""
    wanted = spark.createDataFrame([("0x" + "0" * 39 + x,) for x in "016"], "address string")
    rows = events.filter_contracts(events.log_events(_logs(spark, sf_dir)), wanted)
    return _shown(events.decode(rows, E.ABIS))


@query(f"WITH {_ITEMS} SELECT block, l_orderkey::VARCHAR AS tx, kind FROM items WHERE block BETWEEN 10 AND 900 AND ((contract = {_address('2')} AND kind = 'Returned') OR supplier = {_address('7')})")
def event_criteria_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block range and one of two criteria."""
    some = [scans.EventCriteria(address="0x" + "0" * 39 + "2", topic0="0x" + E.RETURNED.signature.upper()), scans.EventCriteria(topic1="0x" + "0" * 63 + "7")]
    rows = scans.scan(_logs(spark, sf_dir), 10, 900, some)
    return events.decode(events.log_events(rows), E.ABIS).select(F.col("blockNumber").alias("block"), F.col("txId").alias("tx"), F.col("eventType").alias("kind"))


_MOVES = f"moves AS (SELECT o_orderkey // 10 AS block, o_orderkey::VARCHAR AS tx, {_address('o_custkey')} AS sender, {_address('255')} AS recipient, {_cents('o_totalprice')} AS amount FROM orders)"


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.order_transfers(table(spark, sf_dir, "orders"))


def _moves(e: DataFrame) -> DataFrame:
    p = lambda n: P.get(F.col("params"), n)
    return e.select(F.col("blockNumber").alias("block"), F.col("txId").alias("tx"), p("from").alias("sender"), p("to").alias("recipient"), P.as_long(p("amount")).alias("amount"))


@query(f"WITH {_MOVES} SELECT * FROM moves WHERE block <= 5000 AND (sender = {_address('7')} OR sender = {_address('11')})")
def transfer_criteria_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = [scans.TransferCriteria(sender="0x" + "0" * 39 + "7"), scans.TransferCriteria(txOrigin="0x" + "0" * 39 + "B")]
    return _moves(events.log_transfers(scans.scan(_moved(spark, sf_dir), 0, 5000, some)))


@query(f"WITH {_MOVES} SELECT * FROM moves")
def vet_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moves(events.log_transfers(_moved(spark, sf_dir)))


@query("SELECT o_orderkey, place::BIGINT AS place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders) WHERE place BETWEEN 1000 AND 1099")
def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eleventh page of 100 logs."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    got = scans.page(rows, ["o_orderkey"], 1000, 100)
    return got.withColumn("place", F.row_number().over(Window.orderBy("o_orderkey")).cast("bigint") + 999)


_BLOCKS = """ev AS (
  SELECT floor(epoch(ts))::BIGINT // 10 AS number, user_id, event_id, ts, round(abs(value) * 100)::BIGINT AS amount FROM events),
nested AS (
  SELECT *, dense_rank() OVER (PARTITION BY number ORDER BY user_id) - 1 AS tx, row_number() OVER (PARTITION BY number, user_id ORDER BY ts, event_id) - 1 AS clause FROM ev)"""


@query(f"WITH {_BLOCKS} SELECT number AS block, tx::BIGINT AS tx, clause::BIGINT AS clause, 0::BIGINT AS item, event_id FROM nested")
def block_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of transactions of outputs of events, back to rows."""
    rows = events.block_events(E.event_blocks(table(spark, sf_dir, "events")))
    topic = W.uint(W.strip0x(F.get("topics", F.lit(0))))
    return rows.select(F.col("blockNumber").alias("block"), F.col("txIndex").cast("bigint").alias("tx"), F.col("clauseIndex").cast("bigint").alias("clause"), F.col("item").cast("bigint").alias("item"), topic.cast("bigint").alias("event_id"))


@query(f"WITH {_BLOCKS} SELECT number AS block, number || ':' || user_id AS tx, clause::BIGINT AS clause, {_address('user_id')} AS sender, amount, 21000::BIGINT AS gas FROM nested")
def block_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events.block_transfers(E.event_blocks(table(spark, sf_dir, "events")))
    return e.select(F.col("blockNumber").alias("block"), F.col("txId").alias("tx"), F.col("clauseIndex").alias("clause"), P.get(F.col("params"), "from").alias("sender"), P.as_long(P.get(F.col("params"), "amount")).alias("amount"), F.col("gasUsed").alias("gas"))


@query(f"WITH {_BLOCKS} SELECT number AS block, count(DISTINCT tx)::BIGINT AS n, min(number || ':' || user_id) AS first FROM nested GROUP BY number")
def block_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = chain.compressed(E.event_blocks(table(spark, sf_dir, "events")))
    return b.select(F.col("number").alias("block"), F.size("transactions").cast("bigint").alias("n"), F.array_min("transactions").alias("first"))


@query(f"WITH {_ITEMS}, {_MOVES} SELECT block, l_orderkey::VARCHAR AS tx, kind FROM items UNION ALL SELECT block, tx, 'VET_TRANSFER' FROM moves")
def log_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _decoded(spark, sf_dir, False).unionByName(events.log_transfers(_moved(spark, sf_dir)))
    return both.select(F.col("blockNumber").alias("block"), F.col("txId").alias("tx"), F.col("eventType").alias("kind"))


def _static(first: str, operator: str, second: str) -> Condition:
    return Condition(first, False, second, True, operator)


LARGE_RETURN = Definition("LargeReturn", (Alias("Returned", "r", (_static("quantity", "GT", "40"), Condition("supplier", False, "origin", False, "EQ"))),), (), (Taken("supplier", "r", "who"), Taken("price", "r", "amount"), Taken("nothing", "r", "none")), True)
SWAP = Definition("Swap", (Alias("Returned", "out"), Alias("Noted", "in")), (Rule("out", "part", "in", "part", "NE"),), (Taken("part", "out", "given"), Taken("part", "in", "got"), Taken("price", "in", "paid")), True)
ORDER_SWAP = Definition("OrderSwap", (Alias("Returned", "out"), Alias("Accepted", "in")), (Rule("out", "price", "in", "price", "GT"),), (Taken("price", "out", "given"), Taken("price", "in", "got")))
ANY_RETURN = Definition("AnyReturn", (Alias("Returned", "r"),), (), (Taken("part", "r", "given"),), True)


def _found(e: DataFrame, *names: str) -> DataFrame:
    return e.select(F.col("txId").alias("tx"), F.col("clauseIndex").alias("clause"), F.col("eventType").alias("kind"), *[P.get(F.col("params"), n).alias(n) for n in names])


@query(f"WITH {_ITEMS} SELECT l_orderkey::VARCHAR AS tx, l_linenumber::BIGINT AS clause, 'LargeReturn' AS kind, supplier AS who, price::VARCHAR AS amount, '' AS none FROM items WHERE kind = 'Returned' AND quantity > 40")
def business_single_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter and a projection; the supplier is also the transaction's origin."""
    return _found(business.business_events(_decoded(spark, sf_dir), [LARGE_RETURN]), "who", "amount", "none")


def _pairs(other: str, keys: str, good: str, order: str) -> str:
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS k FROM items WHERE kind = 'Returned'),
n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS k FROM items WHERE kind = '{other}'),
p AS (SELECT r.*, n.part AS other_part, n.price AS other_price, n.item AS other_item, {good} AS ok FROM r JOIN n USING ({keys}, k)),
b AS (SELECT *, min(CASE WHEN NOT ok THEN k END) OVER (PARTITION BY {keys}) AS broken FROM p),
swaps AS (SELECT * FROM b WHERE broken IS NULL OR k < broken)"""


_SWAPS = _pairs("Noted", "l_orderkey, l_linenumber", "r.part <> n.part", "item")


@query(f"WITH {_ITEMS}, {_SWAPS} SELECT l_orderkey::VARCHAR AS tx, l_linenumber::BIGINT AS clause, 'Swap' AS kind, part AS given, other_part AS got, other_price::VARCHAR AS paid FROM swaps")
def business_pair_same_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two event types in one clause, matched by rank."""
    return _found(business.business_events(_decoded(spark, sf_dir), [SWAP]), "given", "got", "paid")


_ORDER_SWAPS = _pairs("Accepted", "l_orderkey", "r.price > n.price", "l_linenumber, item")


@query(f"WITH {_ITEMS}, {_ORDER_SWAPS} SELECT l_orderkey::VARCHAR AS tx, l_linenumber::BIGINT AS clause, 'OrderSwap' AS kind, price::VARCHAR AS given, other_price::VARCHAR AS got FROM swaps")
def business_cross_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two event types anywhere in a transaction, with a numeric rule."""
    return _found(business.business_events(_decoded(spark, sf_dir), [ORDER_SWAP]), "given", "got")


@query(f"""WITH {_ITEMS}, {_SWAPS} SELECT l_orderkey::VARCHAR AS tx, l_linenumber::BIGINT AS clause, 'Swap' AS kind, part AS given, other_part AS got FROM swaps
UNION ALL SELECT l_orderkey::VARCHAR, l_linenumber::BIGINT, 'AnyReturn', part, NULL FROM items i
WHERE kind = 'Returned' AND NOT EXISTS (SELECT 1 FROM swaps s WHERE s.l_orderkey = i.l_orderkey AND s.l_linenumber = i.l_linenumber AND s.item = i.item)""")
def business_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two definitions that want one event type: the first takes, the second gets the rest."""
    return _found(business.business_events(_decoded(ship(spark), sf_dir), [SWAP, ANY_RETURN]), "given", "got")


#: Depth first over the pairs of n events, a node for the start, one for each first event and one for each pair: of ten nodes,
#: the first event and its partners get nine, so with n events the pairs (1, 2), ..., (1, 9) are seen, and with few events those
#: of the next first events, as far as the nodes go. A match takes its two events and the search begins anew on the rest.
_TWINS = """cand AS (
  SELECT l_orderkey, l_linenumber, price, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, item) AS k FROM items WHERE kind = 'Returned'),
start AS (SELECT l_orderkey, list({'k': k, 'l': l_linenumber, 'p': price} ORDER BY k) AS pool FROM cand GROUP BY l_orderkey),
step AS (
  SELECT l_orderkey, pool, 0 AS round, NULL::BIGINT AS clause, NULL::BIGINT AS low, NULL::BIGINT AS high FROM start WHERE len(pool) >= 2
  UNION ALL
  SELECT l_orderkey, list_filter(pool, lambda x: x.k <> pair.a.k AND x.k <> pair.b.k), round + 1, pair.a.l, pair.a.p, pair.b.p
  FROM (SELECT l_orderkey, pool, round, list_filter(list_transform(flatten(list_transform(range(1, len(pool) + 1), lambda i: list_transform(
            list_filter(range(1, len(pool) + 1), lambda j: j <> i), lambda j: {'i': i, 'j': j, 'node': 1 + (i - 1) * len(pool) + 1 + CASE WHEN j < i THEN j ELSE j - 1 END}))),
          lambda q: {'a': pool[q.i], 'b': pool[q.j], 'node': q.node}), lambda q: q.node <= 10 AND q.a.p < q.b.p)[1] AS pair FROM step WHERE len(pool) >= 2)
  WHERE pair IS NOT NULL)"""


@query(f"WITH RECURSIVE {_ITEMS}, {_TWINS} SELECT l_orderkey::VARCHAR AS tx, clause::BIGINT AS clause, 'Twin' AS kind, low::VARCHAR AS low, high::VARCHAR AS high FROM step WHERE round > 0")
def business_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth-first over combinations within ten nodes."""
    d = Definition("Twin", (Alias("Returned", "a"), Alias("Returned", "b")), (Rule("a", "price", "b", "price", "LT"),), (Taken("price", "a", "low"), Taken("price", "b", "high")), every_combination=True)
    return _found(business.business_events(_decoded(ship(spark), sf_dir), [d]), "low", "high")


@query(f"""WITH {_ITEMS}, {_SWAPS}, used AS (SELECT DISTINCT l_orderkey, l_linenumber FROM swaps)
SELECT l_orderkey::VARCHAR AS tx, l_linenumber::BIGINT AS clause, kind FROM items i WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.l_orderkey = i.l_orderkey AND u.l_linenumber = i.l_linenumber)
UNION ALL SELECT l_orderkey::VARCHAR, l_linenumber::BIGINT, 'Swap' FROM swaps""")
def dedup_abi_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with a business event lose all their plain ones."""
    out = combine.process(events.log_events(_logs(spark, sf_dir, True)), None, E.ABIS, [SWAP])
    return out.select(F.col("txId").alias("tx"), F.col("clauseIndex").alias("clause"), F.col("eventType").alias("kind"))


@query(f"WITH {_ITEMS} SELECT l_orderkey || '-' || l_linenumber || '-' || item AS id, kind FROM items")
def event_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of an event's id before its hash."""
    return _decoded(spark, sf_dir).select(F.substring_index("id", "-", 3).alias("id"), F.col("eventType").alias("kind"))


_MIXED = "(SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN (value * 100)::BIGINT::VARCHAR WHEN 2 THEN '1' || repeat('0', (event_id % 40)::INT) WHEN 3 THEN '-' || event_id ELSE (event_id % 90) || '.5' END AS a, CASE event_id % 3 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN upper(event_type) ELSE '1' || repeat('0', (event_id % 37)::INT) END AS b FROM events)"
_NUM = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


@query(f"""WITH m AS {_MIXED}, n AS (SELECT *, regexp_matches(a, {_NUM}) AND regexp_matches(b, {_NUM}) AS num, regexp_matches(a, '^-') AS minus, regexp_replace(a, '^[+-]?0*', '') AS da, regexp_replace(b, '^[+-]?0*', '') AS db FROM m),
o AS (SELECT *, CASE WHEN num AND (a LIKE '%.%') THEN CASE WHEN a::DOUBLE < b::DOUBLE THEN -1 WHEN a::DOUBLE > b::DOUBLE THEN 1 ELSE 0 END
  WHEN num AND minus THEN CASE WHEN da = '' AND db = '' THEN 0 ELSE -1 END
  WHEN num THEN CASE WHEN length(da) < length(db) OR (length(da) = length(db) AND da < db) THEN -1 WHEN da = db THEN 0 ELSE 1 END
  ELSE CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END END AS c FROM n)
SELECT event_id, lower(a) = lower(b) AS eq, a <> b AS ne, c > 0 AS gt, c < 0 AS lt, c >= 0 AS ge, c <= 0 AS le FROM o""")
def operator_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six operators over words, decimals, negative and very long numbers."""
    i = F.col("event_id")
    a = F.when(i % 5 == 0, F.col("event_type")).when(i % 5 == 1, F.round(F.col("value") * 100).cast("bigint").cast("string")).when(i % 5 == 2, F.concat(F.lit("1"), F.repeat(F.lit("0"), (i % 40).cast("int")))).when(i % 5 == 3, F.concat(F.lit("-"), i.cast("string"))).otherwise(F.concat((i % 90).cast("string"), F.lit(".5")))
    b = F.when(i % 3 == 0, F.col("user_id").cast("string")).when(i % 3 == 1, F.upper("event_type")).otherwise(F.concat(F.lit("1"), F.repeat(F.lit("0"), (i % 37).cast("int"))))
    m = table(spark, sf_dir, "events").select("event_id", a.alias("a"), b.alias("b"))
    return m.select("event_id", *[P.compare(o, F.col("a"), F.col("b")).alias(o.lower()) for o in ("EQ", "NE", "GT", "LT", "GE", "LE")])


_GETTERS = "(SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN 'TRUE' WHEN 3 THEN repeat('9', 19 + (event_id % 20)::INT) WHEN 4 THEN '-00' || event_id ELSE event_type END AS x FROM events)"


@query(f"""SELECT event_id, CASE WHEN trim(x) <> '' THEN x END AS s, TRY_CAST(CASE WHEN regexp_matches(x, '^[+-]?[0-9]+$') THEN x END AS INTEGER)::BIGINT AS i, TRY_CAST(CASE WHEN regexp_matches(x, '^[+-]?[0-9]+$') THEN x END AS BIGINT) AS l,
lower(x) = 'true' AS b, CASE WHEN x LIKE '-00%' THEN CASE WHEN event_id = 0 THEN '0' ELSE '-' || event_id END WHEN regexp_matches(x, '^[0-9]+$') THEN x END AS big FROM {_GETTERS}""")
def param_getters(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    x = F.when(i % 6 == 0, F.lit(" ")).when(i % 6 == 1, i.cast("string")).when(i % 6 == 2, F.lit("TRUE")).when(i % 6 == 3, F.repeat(F.lit("9"), (19 + i % 20).cast("int"))).when(i % 6 == 4, F.concat(F.lit("-00"), i.cast("string"))).otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("x"), x).alias("params"))
    got = P.get(F.col("params"), "x")
    return rows.select("event_id", P.as_string(got).alias("s"), P.as_int(got).cast("bigint").alias("i"), P.as_long(got).alias("l"), P.as_boolean(got).alias("b"), P.as_big_integer(got).alias("big"))


_HEADS = """h AS (SELECT DISTINCT floor(epoch(ts))::BIGINT // 10 AS number FROM events),
g AS (SELECT number, CASE WHEN number % 97 = 0 THEN 'fork' ELSE 'b' || coalesce(lag(number) OVER (PARTITION BY number // 100000 ORDER BY number), number - 1) END AS parent, lag(number) OVER (ORDER BY number) AS before FROM h)"""


@query(f"WITH {_HEADS} SELECT number, before AS previous, parent FROM g WHERE before IS NOT NULL AND parent <> 'b' || before")
def reorg_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose parent is not the block before, with windows of one bucket of numbers each."""
    out = chain.reorganised(E.block_heads(table(spark, sf_dir, "events")), bucket=5000)
    return out.select("number", F.col("previousNumber").alias("previous"), F.col("parentID").alias("parent"))


@query(f"WITH {_HEADS} SELECT number, before AS previous, number - before - 1 AS missing FROM g WHERE number <> before + 1")
def chain_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chain.gaps(E.block_heads(table(spark, sf_dir, "events")), bucket=5000)
    return out.select("number", F.col("previousNumber").alias("previous"), (F.col("number") - F.col("previousNumber") - 1).alias("missing"))


@query(f"WITH {_ITEMS} SELECT block // 100 AS batch, count(*)::BIGINT AS n, min(block) AS first, max(block) AS last, least((block // 100) * 100 + 99, 1200) AS until FROM items GROUP BY ALL")
def block_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs in runs of 100 blocks."""
    e = _logs(spark, sf_dir).select(F.col("meta.blockNumber").alias("block"))
    out = e.groupBy(chain.batch(F.col("block"), 0, 100).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("first"), F.max("block").alias("last"))
    return out.withColumn("until", chain.batch_end(F.col("batch") * 100, 100, 1200))


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN event_id % 20 ELSE least(event_id % 20, greatest((1706000000 - floor(epoch(ts))::BIGINT) // 10, 0) + 1) END::BIGINT AS size FROM events")
def prefetch_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.unix_timestamp("ts").alias("t"))
    last = F.when(F.col("event_id") % 11 != 0, F.col("t"))
    return e.select("event_id", chain.prefetch(last, 1706000000, F.col("event_id") % 20).alias("size"))


@query("SELECT event_id, CASE WHEN 1706572790 - floor(epoch(ts))::BIGINT < 15 THEN 'FULLY_SYNCED' ELSE 'SYNCING' END AS status FROM events")
def sync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", chain.status(F.unix_timestamp("ts"), 1706572790).alias("status"))


@query("SELECT grp, min(current) AS first, max(current) AS last, count(*)::BIGINT AS n FROM (SELECT current, sum(gap) OVER (ORDER BY current, name ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM (SELECT *, CASE WHEN current - lag(current) OVER (ORDER BY current, name) > 600 THEN 1 ELSE 0 END AS gap FROM (SELECT s_name AS name, round(s_acctbal * 10)::BIGINT AS current FROM supplier))) GROUP BY grp")
def proximity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as indexers whose balance is their position."""
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.round(F.col("s_acctbal") * 10).cast("bigint").alias("current"))
    return schedule.group_ranges(schedule.proximity_table(nodes, 600))


@query("WITH RECURSIVE n AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey > 5 THEN s_suppkey // 2 END AS d FROM supplier), r AS (SELECT k, k AS root, 0 AS depth FROM n WHERE d IS NULL UNION ALL SELECT n.k, r.root, r.depth + 1 FROM n JOIN r ON n.d = r.k) SELECT 'i' || k AS name, 'i' || root AS root, depth::BIGINT AS depth FROM r")
def topo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexers that depend on the one with half their number: root and distance of each."""
    k = F.col("s_suppkey")
    i = lambda c: F.concat(F.lit("i"), c.cast("string"))
    nodes = table(spark, sf_dir, "supplier").select(i(k).alias("name"), F.when(k > 5, i(F.floor(k / 2))).alias("dependsOn"))
    return schedule.depth(nodes).withColumn("depth", F.col("depth").cast("bigint"))


@query("WITH c AS (SELECT l_orderkey AS consumer, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS ordinal, l_suppkey AS target FROM lineitem), f AS (SELECT target, min((consumer, ordinal)) AS first FROM c GROUP BY target), i AS (SELECT target, row_number() OVER (ORDER BY first) - 1 AS idx FROM f) SELECT consumer, ordinal, c.target, idx FROM c JOIN i ON c.target = i.target")
def clause_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all consumers, each with the number of the distinct call it shares."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("consumer"), F.row_number().over(w).cast("bigint").alias("ordinal"), F.col("l_suppkey").alias("target"))
    return schedule.merge_calls_table(calls, ["target"]).select("consumer", "ordinal", "target", "idx")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '-' ELSE '' END || ((event_id % 9 + 1)::HUGEINT * (1::HUGEINT << (62 + event_id % 50)::INT))::VARCHAR AS value, ((event_id % 9 + 1)::HUGEINT * (1::HUGEINT << (62 + event_id % 50)::INT))::VARCHAR AS amount FROM events")
def abi_decode_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers over 2**60, signed and as hex amounts."""
    i = F.col("event_id")
    size = F.lit(62) + i % 50
    # the digits of m * 2**size, whole hex digits after the first few bits
    head = F.lower(F.hex(F.call_function("shiftleft", i % 9 + 1, (size % 4).cast("int"))))
    digits = F.concat(head, F.repeat(F.lit("0"), F.floor(size / 4).cast("int")))
    word = F.lpad(digits, 64, "0")
    # two's complement: digits after the last one that is not 0 stay, that one is 16 - d, those before are 15 - d
    tail = F.length(F.regexp_extract(word, "0*$", 0))
    body = F.substring(word, F.lit(1), F.lit(63) - tail)
    last = F.substring(word, F.lit(64) - tail, F.lit(1))
    flipped = F.concat(F.translate(body, "0123456789abcdef", "fedcba9876543210"), F.translate(last, "123456789abcdef", "fedcba987654321"), F.repeat(F.lit("0"), tail))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(i % 3 == 0, flipped).otherwise(word).alias("data"), F.concat(F.lit("0x"), digits).alias("raw"))
    return rows.select("event_id", *decode.typed([Param("value", "int256")], F.col("data")), W.quantity(F.col("raw")).alias("amount"))


@query("SELECT event_id, (CASE event_id % 4 WHEN 0 THEN (event_id * 125) // 1000 || '.' || lpad(((event_id * 125) % 1000)::VARCHAR, 3, '0') WHEN 1 THEN '-' || event_id WHEN 2 THEN event_id % 90 || '.5' END)::DECIMAL(38, 18) AS value FROM events")
def param_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal parameters: fractions, integers, exponents and words."""
    i = F.col("event_id")
    x = F.when(i % 4 == 0, (i.cast("decimal(20,0)") / 8).cast("decimal(30,3)").cast("string")).when(i % 4 == 1, F.concat(F.lit("-"), i.cast("string"))).when(i % 4 == 2, F.concat(((i % 90) * 10 + 5).cast("string"), F.lit("e-1"))).otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("x"), x).alias("params"))
    return rows.select("event_id", P.as_big_decimal(P.get(F.col("params"), "x")).alias("value"))


#: Fixed value: the topic of the standard transfer event of tokens.
_TRANSFER_TOPIC = "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"


@query(f"SELECT o_orderkey, '{_TRANSFER_TOPIC}' AS signature, 'Transfer' AS kind, {_address('o_custkey')} AS sender, {_cents('o_totalprice')} AS value FROM orders WHERE o_orderkey % 2 = 0")
def known_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with a published topic 0 among others: the registry computes the same hash."""
    word = lambda x: E.payload(W.encode_uint(x))
    topic = F.when(F.col("o_orderkey") % 2 == 0, F.lit("0x" + _TRANSFER_TOPIC)).otherwise(F.lit("0x" + "1" * 64))
    abi = Abi("Transfer", "event", (Param("from", "address", True), Param("to", "address", True), Param("value", "uint256")))
    o = F.col("o_orderkey")
    logs = table(spark, sf_dir, "orders").select(
        W.encode_address(F.col("o_custkey")).alias("address"), F.array(topic, word(F.col("o_custkey")), word(F.lit(1))).alias("topics"),
        word(E.cents(F.col("o_totalprice"))).alias("data"), E.meta(F.floor(o / 10), o, W.encode_address(F.col("o_custkey")), F.lit(0)).alias("meta"),
    )
    e = events.decode(events.log_events(logs), [abi])
    p = lambda n: P.get(F.col("params"), n)
    return e.select(F.col("txId").cast("bigint").alias("o_orderkey"), "signature", F.col("eventType").alias("kind"), p("from").alias("sender"), P.as_long(p("value")).alias("value"))


@query(f"WITH {_BLOCKS} SELECT number AS block, number || ':' || user_id AS tx, clause::BIGINT AS clause, length(event_type)::BIGINT AS size, '0x1' AS paid, 21000::BIGINT AS gas, {_address('user_id')} AS payer, {_address('user_id')} AS origin FROM nested JOIN (SELECT event_id, event_type FROM events) USING (event_id)")
def block_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of blocks decoded, with the gas fields of their transactions."""
    blocks = E.event_blocks(table(spark, sf_dir, "events"), E.SIZED.signature)
    e = events.decode(events.block_events(blocks), [E.SIZED])
    return e.select(F.col("blockNumber").alias("block"), F.col("txId").alias("tx"), F.col("clauseIndex").alias("clause"), P.as_long(P.get(F.col("params"), "size")).alias("size"), "paid", F.col("gasUsed").alias("gas"), F.col("gasPayer").alias("payer"), "origin")


def _node(spark: SparkSession, sf_dir: str) -> str:
    """A folder of blocks for the chain source, where executors see it too: suppliers as blocks with one transfer each."""
    shared = urlsplit(shared_folder(spark))
    if shared.scheme not in ("", "file"):
        raise ValueError("the blocks need a folder that the driver and all executors share as files")
    at = Path(shared.path) / f"node-{uuid.uuid4().hex}" / "blocks"
    at.mkdir(parents=True)
    for r in table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", E.cents(F.col("s_acctbal")).alias("balance")).orderBy("s_suppkey").toLocalIterator():
        moved = {"sender": f"0x{r.s_suppkey:040x}", "recipient": f"0x{r.s_nationkey:040x}", "amount": hex(abs(r.balance))}
        tx = {"id": f"t{r.s_suppkey}", "origin": moved["sender"], "gasPayer": moved["sender"], "paid": "0x1", "gasUsed": 1, "reverted": False, "outputs": [{"contractAddress": None, "events": [], "transfers": [moved]}]}
        n = r.s_suppkey
        (at / f"{n}.json").write_text(json.dumps({"number": n, "id": f"b{n}", "parentID": f"b{n - 1}", "timestamp": n * 10, "transactions": [tx]}))
    return str(at.parent)


_MOVED = "SELECT s_suppkey AS block, 'b' || s_suppkey AS id, abs(round(s_acctbal * 100)::BIGINT) AS amount FROM supplier"


@query(f"{_MOVED} WHERE s_suppkey >= (SELECT min(s_suppkey) + 3 FROM supplier)")
def chain_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers of a node by the chain source: a start block, pages of two logs, a task for every seven blocks."""
    first = table(spark, sf_dir, "supplier").agg(F.min("s_suppkey")).first()[0]
    at = _node(register(ship(spark)), sf_dir)
    logs = spark.read.format("chain").options(mode="transfers", path=at, startBlock=first + 3, blockBatchSize=7, logFetchLimit=2).load()
    e = events.log_transfers(logs)
    return e.select(F.col("blockNumber").alias("block"), F.col("blockId").alias("id"), P.as_long(P.get(F.col("params"), "amount")).alias("amount"))


@query(f"SELECT block, id, amount, ((block - (SELECT min(s_suppkey) FROM supplier)) // 25)::BIGINT AS turn FROM ({_MOVED})")
def chain_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a node as a stream of 25 blocks a trigger; the turn is the number of the micro-batch."""
    first = table(spark, sf_dir, "supplier").agg(F.min("s_suppkey")).first()[0]
    at, out = _node(register(ship(spark)), sf_dir), f"{shared_folder(spark)}/chain-{uuid.uuid4().hex}"
    rows = spark.readStream.format("chain").options(path=at, startBlock=first, maxBlocksPerTrigger=25).load()
    e = events.block_transfers(rows)
    e = e.select(F.col("blockNumber").alias("block"), F.col("blockId").alias("id"), P.as_long(P.get(F.col("params"), "amount")).alias("amount"))
    # the plan above is made once and the turn is its folder's name, so a micro-batch is no more than a write
    step = lambda batch, turn: batch.write.mode("overwrite").parquet(f"{out}/rows/turn={turn}")
    stream = e.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/checkpoint").start()
    stream.processAllAvailable()
    stream.stop()
    return spark.read.schema("block bigint, id string, amount bigint, turn bigint").parquet(f"{out}/rows")


_RAW = "(SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' BEST ' WHEN 1 THEN '00' || event_id WHEN 2 THEN '0x' || repeat('A', 64) WHEN 3 THEN '0x12' ELSE event_type END AS x FROM events)"


@query(f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'keyword' WHEN 1 THEN 'number' WHEN 2 THEN 'id' END AS kind, CASE event_id % 5 WHEN 0 THEN 'best' WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN lower(x) END AS value FROM {_RAW}")
def revision_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    x = F.when(i % 5 == 0, F.lit(" BEST ")).when(i % 5 == 1, F.concat(F.lit("00"), i.cast("string"))).when(i % 5 == 2, F.lit("0x" + "A" * 64)).when(i % 5 == 3, F.lit("0x12")).otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", x.alias("x"))
    return rows.select("event_id", revision.kind(F.col("x")).alias("kind"), revision.canonical(F.col("x")).alias("value"))


@query("SELECT p_brand AS brand, p_size::BIGINT AS size, p_partkey AS ordinal, p_name AS name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) = 1")
def registry_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry of each shape."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").cast("bigint").alias("size"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("name"))
    return registry.first_of_each(p, ["brand", "size"])


@query(f"WITH {_ITEMS} SELECT {_SHOWN} FROM items WHERE block < 700")
def rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.rolled_back(_shown(_decoded(spark, sf_dir, False)), 700, "block")


@query(f"WITH {_ITEMS} SELECT {_SHOWN} FROM items WHERE block >= 700")
def skip_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _shown(_decoded(spark, sf_dir, False)).withColumnRenamed("block", "number")
    return chain.pending(e, 700).withColumnRenamed("number", "block")


@query(f"WITH {_BLOCKS}, b AS (SELECT DISTINCT number FROM nested) SELECT number AS block, (number * 3)::VARCHAR AS second, (number * 2)::VARCHAR AS first FROM b")
def inspection_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of calls on each block, picked by a consumer's index."""
    b = E.block_heads(table(spark, sf_dir, "events"))
    results = b.select(F.col("id").alias("blockId"), F.array(*[(F.col("number") * k).cast("string") for k in (1, 2, 3)]).alias("results"))
    out = chain.with_inspections(b, results, [2, 1])
    return out.select(F.col("number").alias("block"), F.get("callResults", F.lit(0)).alias("second"), F.get("callResults", F.lit(1)).alias("first"))


@query("SELECT CASE WHEN number % 1000 = 0 THEN number ELSE number END AS number FROM (SELECT DISTINCT floor(epoch(ts))::BIGINT // 10 AS number FROM events) WHERE number % 1000 = 0 OR 1706572790 - number * 10 < 15")
def progress_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks at which progress is logged."""
    return chain.progress(E.block_heads(table(spark, sf_dir, "events")), 1000, 1706572790).select("number")


@query(f"WITH {_ITEMS} SELECT {_SHOWN} FROM items")
def streaming_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch decode as a bounded stream."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(table(spark, sf_dir, "lineitem").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/lineitem.parquet*")
    out = _shown(events.decode(events.log_events(E.item_logs(rows)), E.ABIS))
    out.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows")
