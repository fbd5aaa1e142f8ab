"""Encode, then decode: the typed values come back."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import decode
from tidemark.operators.registry import Abi, Param


def word(x):
    return f"{x % 2**256:064x}"


def encode(p, v):
    """(static body or None, dynamic body or None) of a value by the contract ABI."""
    if p.type.endswith("]"):
        item = Param("", p.type[: p.type.rindex("[")], components=p.components)
        fixed = p.type[p.type.rindex("[") + 1 : -1]
        return ("" if fixed else word(len(v))) + tuple_([item] * len(v), v)
    if p.type == "tuple":
        return tuple_(p.components, v)
    if p.type in ("string", "bytes"):
        raw = v.encode() if p.type == "string" else v
        return word(len(raw)) + raw.hex() + "0" * (-len(raw) % 32 * 2)
    if p.type.startswith("bytes"):
        return v.hex().ljust(64, "0")
    if p.type == "address":
        return word(int(v, 16))
    return word(int(v))


def tuple_(params, values):
    heads, tails = [], ""
    size = sum(decode.head_words(p) for p in params) * 32
    for p, v in zip(params, values, strict=True):
        body = encode(p, v)
        if decode.dynamic(p):
            heads.append(word(size + len(tails) // 2))
            tails += body
        else:
            heads.append(body)
    return "".join(heads) + tails


def plain(x):
    if hasattr(x, "asDict"):
        return [plain(v) for v in x]
    return [plain(v) for v in x] if isinstance(x, list) else x


def shown(p, v):
    if p.type.endswith("]"):
        item = Param("", p.type[: p.type.rindex("[")], components=p.components)
        return [shown(item, x) for x in v]
    if p.type == "tuple":
        return [shown(c, x) for c, x in zip(p.components, v, strict=True)]
    if isinstance(v, bytes):
        return "0x" + v.hex()
    return v if isinstance(v, (bool, str)) else str(v)


PAIR = (Param("a", "uint256"), Param("b", "address"))
WORDY = (Param("s", "string"), Param("n", "int64"))
A = "0x" + "ab" * 20
CASES = [
    ([Param("x", "uint256"), Param("y", "bool"), Param("z", "address")], [2**200, True, A]),
    ([Param("t", "tuple", components=PAIR), Param("after", "uint8")], [[5, A], 7]),
    ([Param("k", "uint64[3]"), Param("after", "string")], [[1, 2, 3], "héllo"]),
    ([Param("s", "string"), Param("b", "bytes"), Param("m", "bytes4")], ["", b"\x01\x02\x03", b"\xde\xad\xbe\xef"]),
    ([Param("l", "string[]"), Param("e", "uint256[]"), Param("n", "int8")], [["a" * 40, "b"], [], -3]),
    ([Param("d", "tuple[]", components=WORDY)], [[["x", -1], ["y" * 33, 2]]]),
    ([Param("st", "tuple[]", components=PAIR), Param("q", "uint256")], [[[1, A], [2, A]], 9]),
    ([Param("m", "uint256[2][3]"), Param("q", "uint256")], [[[1, 2], [3, 4], [5, 6]], 8]),
    ([Param("d", "tuple", components=(Param("in", "tuple", components=WORDY), Param("k", "uint256[]")))], [[["z", 4], [7, 8]]]),
    ([Param("sk", "string[2]")], [["one", "two" * 20]]),
]


@pytest.mark.parametrize("params, values", CASES)
def test_round_trip(spark, params, values):
    df = spark.createDataFrame([(tuple_(params, values),)], "data string")
    row = df.select(*decode.typed(params, F.col("data"))).first()
    assert [plain(v) for v in row] == [shown(p, v) for p, v in zip(params, values, strict=True)]


def test_cut_and_random_payloads_never_raise(spark):
    rng = random.Random(3)
    rows = []
    for params, values in CASES:
        whole = tuple_(params, values)
        rows += [whole[: rng.randrange(len(whole))] for _ in range(6)]
        rows += ["".join(rng.choice("0f8z") for _ in range(rng.randrange(400))) for _ in range(4)]
    df = spark.createDataFrame([(r,) for r in rows], "data string")
    for params, _ in CASES:
        assert len(df.select(*decode.typed(params, F.col("data"))).collect()) == len(rows)


def test_event_parameters_fall_back(spark):
    abi = Abi("E", "event", (Param("who", "address", True), Param("name", "string", True), Param("odd", "fixed128x18"), Param("n", "uint256"), Param("s", "string")))
    topics = ["0x" + abi.signature, "0x" + word(5), "0x" + "ff" * 32]
    df = spark.createDataFrame([(topics, word(1) + word(12))], "topics array<string>, data string")
    got = df.select(decode.event_params(abi, F.col("topics"), F.col("data")).alias("p")).first().p
    assert got == {"who": "0x" + "0" * 39 + "5", "name": topics[2], "odd": "0x", "n": "12", "s": "0x"}


def test_canonical_text_of_nested_values(spark):
    abi = Abi("E", "event", (Param("l", "uint256[]"), Param("m", "bytes4")))
    df = spark.createDataFrame([(["0x" + abi.signature], tuple_(abi.inputs, [[1, 2], b"\x01\x02\x03\x04"]))], "topics array<string>, data string")
    got = df.select(decode.event_params(abi, F.col("topics"), F.col("data")).alias("p")).first().p
    assert json.loads(got["l"]) == ["1", "2"]
    assert got["m"] == "0x" + "01020304".ljust(64, "0")


def test_return_data_with_and_without_selector(spark):
    outputs = [Param("a", "uint64[10]"), Param("b", "bool")]
    body = tuple_(outputs, [list(range(10)), True])
    df = spark.createDataFrame([("0x" + body,), ("0xdeadbeef" + body,)], "raw string")
    for row in df.select(*decode.returns(outputs, F.col("raw"))).collect():
        assert row.a == [str(i) for i in range(10)] and row.b is True


def test_which_types_are_known():
    good = ["address", "bool", "string", "bytes", "bytes32", "uint", "uint256", "uint9", "int8", "uint8[]", "string[2][]"]
    assert all(decode.known(Param("x", t)) for t in good)
    assert not any(decode.known(Param("x", t)) for t in ["bytes33", "uint300", "uint7", "fixed", "tuple2", "function"])


def test_the_last_input_of_a_repeated_name_counts(spark):
    from tidemark.operators.decode import event_params

    abi = Abi("Twice", "event", (Param("x", "uint256"), Param("y", "uint256"), Param("x", "uint256")))
    data = "".join(f"{n:064x}" for n in (1, 2, 3))
    got = spark.createDataFrame([(["0x" + abi.signature], data)], "topics array<string>, data string").select(event_params(abi, F.col("topics"), F.col("data")).alias("p")).first().p
    assert got == {"x": "3", "y": "2"}
