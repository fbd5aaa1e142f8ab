import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import keccak
from tidemark.functions import params as P
from tidemark.functions import words as W


def test_keccak_vectors():
    assert keccak.keccak256(b"") == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak.signature("Transfer(address,address,uint256)") == "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"


@settings(max_examples=5)
@given(st.binary(min_size=130, max_size=280))
def test_keccak_length_is_fixed(data):
    assert len(keccak.keccak256(data)) == 64


def test_integers_of_any_width(spark):
    rng = random.Random(1)
    some = [0, 1, 10**9, 2**60, 2**64 - 1, 10**38, 2**256 - 1] + [rng.getrandbits(rng.randrange(1, 256)) for _ in range(30)]
    rows = spark.createDataFrame([(str(x), f"{x:064x}") for x in some], "v string, w string")
    assert all(a == b for a, b in rows.select("v", W.uint(F.col("w"))).collect())
    some = [-1, -(2**63), -(2**255), 2**255 - 1] + [-rng.getrandbits(200) for _ in range(20)]
    rows = spark.createDataFrame([(str(x), f"{x % 2**256:064x}") for x in some], "v string, w string")
    assert all(a == b for a, b in rows.select("v", W.sint(F.col("w"))).collect())


def test_quantity_rejects_what_is_not_hex(spark):
    rows = spark.createDataFrame([("0x64",), ("100",), ("zz",), ("0x",), (None,), ("0x" + "f" * 65,)], "x string")
    assert [r[0] for r in rows.select(W.quantity(F.col("x"))).collect()] == ["100", "256", None, None, None, None]


def test_prefixes_and_bool(spark):
    rows = spark.createDataFrame([("0xab",), ("ab",), ("0Xab",)], "x string")
    assert [tuple(r) for r in rows.select(W.strip0x(F.col("x")), W.add0x(F.col("x"))).collect()] == [("ab", "0xab"), ("ab", "0xab"), ("0Xab", "0x0Xab")]
    w = spark.createDataFrame([("0" * 63 + "1",), ("0" * 63 + "2",), ("0" * 64,)], "w string")
    assert [r[0] for r in w.select(W.boolean(F.col("w"))).collect()] == [True, False, False]


def test_getters(spark):
    rows = spark.createDataFrame([("12",), (" 12 ",), ("true",), ("no",), ("",), (None,), ("9" * 30,), ("-007",), ("1.5",)], "x string")
    x = F.col("x")
    got = [tuple(r) for r in rows.select(P.as_string(x), P.as_int(x), P.as_long(x), P.as_boolean(x), P.as_big_integer(x), P.as_big_decimal(x, 2).cast("string")).collect()]
    assert got[0] == ("12", 12, 12, False, "12", "12.00")
    assert got[1] == (" 12 ", None, None, False, None, None)
    assert got[2][3] is True and got[4][0] is None and got[5] == (None,) * 6
    assert got[6][4] == "9" * 30 and got[6][2] is None
    assert got[7][4] == "-7" and got[8][5] == "1.50"


def test_comparison_operators(spark):
    cases = [("Ab", "aB"), ("10", "9"), ("10", "x"), ("-5", "-40"), ("1" + "0" * 40, "1" + "0" * 39), ("1.5", "1.50"), ("0", "-0"), (None, "1")]
    rows = spark.createDataFrame(cases, "a string, b string")
    got = [tuple(r) for r in rows.select(*[P.compare(o, F.col("a"), F.col("b")) for o in ("EQ", "NE", "GT", "LE")]).collect()]
    assert got[0][:2] == (True, True)
    assert [g[2] for g in got[1:7]] == [True, False, True, True, False, False]
    assert got[7][0] is None
