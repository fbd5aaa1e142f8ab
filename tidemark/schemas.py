"""Row types of chain data. Numbers that may pass 64 bits stay hex text on the way in.

Workers import this module, so types are built without a session.
"""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType())}


def _row(text: str, **nested: T.DataType) -> T.StructType:
    """``name kind`` pairs, separated by commas; a kind may be one that is given by name."""
    kinds = _KINDS | nested
    return T.StructType([T.StructField(*(kinds[x] if i else x for i, x in enumerate(cell.split()))) for cell in text.split(",")])


META = _row("blockID string, blockNumber long, blockTimestamp long, txID string, txOrigin string, clauseIndex int")
EVENT_LOG = _row("address string, topics strings, data string, meta meta", meta=META)
TRANSFER_LOG = _row("sender string, recipient string, amount string, meta meta", meta=META)

CLAUSE = _row("to string, value string, data string")
_EVENTS = T.ArrayType(_row("address string, topics strings, data string"))
_TRANSFERS = T.ArrayType(_row("sender string, recipient string, amount string"))
OUTPUT = _row("contractAddress string, events events, transfers transfers", events=_EVENTS, transfers=_TRANSFERS)
TRANSACTION = _row(
    "id string, type long, chainTag long, blockRef string, expiration long, clauses clauses, gasPriceCoef long, gas long, maxFeePerGas string, maxPriorityFeePerGas string, "
    "origin string, delegator string, nonce string, dependsOn string, size long, gasUsed long, gasPayer string, paid string, reward string, reverted boolean, outputs outputs",
    clauses=T.ArrayType(CLAUSE),
    outputs=T.ArrayType(OUTPUT),
)
_HEAD = (
    "number long, id string, size long, parentID string, timestamp long, gasLimit long, baseFeePerGas string, beneficiary string, gasUsed long, totalScore long, "
    "txsRoot string, txsFeatures int, stateRoot string, receiptsRoot string, com boolean, signer string, isTrunk boolean, isFinalized boolean, transactions transactions"
)
BLOCK = _row(_HEAD, transactions=T.ArrayType(TRANSACTION))
BLOCK_COMPRESSED = _row(_HEAD, transactions=T.ArrayType(T.StringType()))

INSPECTION = _row("data string, events events, transfers transfers, gasUsed long, reverted boolean, vmError string", events=_EVENTS, transfers=_TRANSFERS)
ACCOUNT = _row("balance string, energy string, hasCode boolean")

#: The row that every decoder and matcher returns. ``seq`` is its place in the chain.
INDEXED_EVENT = _row(
    "id string, blockId string, blockNumber long, blockTimestamp long, txId string, origin string, paid string, gasUsed long, gasPayer string, raw raw, params params, "
    "address string, eventType string, clauseIndex long, signature string, seq seq",
    raw=_row("data string, topics strings"),
    params=T.MapType(T.StringType(), T.StringType()),
    seq=_row("block long, tx long, clause long, kind int, item long"),
)
#: Fields of an event that conditions and rules can name.
FIELDS = ("id", "blockId", "blockNumber", "blockTimestamp", "txId", "origin", "address", "eventType", "clauseIndex", "signature", "gasPayer")
#: Fixed value: the type of native transfers, which definitions refer to.
TRANSFER = "VET_TRANSFER"
