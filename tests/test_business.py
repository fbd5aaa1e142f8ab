"""The planned strategies against the matching loop, and the loop against the stated semantics."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import business as B
from tidemark.operators import combine
from tidemark.operators.business import Alias, Condition, Definition, Rule, Taken
from tidemark.schemas import INDEXED_EVENT


def event(tx, clause, item, kind, **params):
    return {
        "id": f"{tx}-{clause}-{item}-x", "blockId": "b1", "blockNumber": 1, "blockTimestamp": 10, "txId": tx, "origin": "0xA", "paid": None, "gasUsed": None, "gasPayer": None, "raw": None,
        "params": {k: str(v) for k, v in params.items()}, "address": "0xC", "eventType": kind, "clauseIndex": clause, "signature": None, "seq": {"block": 1, "tx": 0, "clause": clause, "kind": 0, "item": item},
    }


def frame(spark, rows):
    return spark.createDataFrame(rows, INDEXED_EVENT)


def rows(n, seed, kinds="ABC"):
    rng = random.Random(seed)
    return [event(f"t{rng.randrange(8)}", rng.randrange(2), i, rng.choice(kinds), v=rng.randrange(6), w=rng.randrange(3)) for i in range(n)]


def pair(same=True, rules=(), **kw):
    return Definition("Pair", (Alias("A", "a"), Alias("B", "b")), tuple(rules), (Taken("v", "a", "x"), Taken("v", "b", "y")), same, **kw)


ONE = Definition("One", (Alias("A", "a", (Condition("v", False, "3", True, "GT"),)),), (), (Taken("v", "a", "x"), Taken("none", "a", "n")), True)


def loop(data, definitions):
    out = []
    by_tx = {}
    for e in sorted(data, key=lambda e: tuple(e["seq"].values())):
        by_tx.setdefault(e["txId"], []).append(e)
    for own in by_tx.values():
        for d, found in B.match(own, definitions):
            first = found[d.aliases[0].alias]
            out.append((d.name, first["txId"], first["clauseIndex"], tuple(sorted((p.as_name, found[p.alias]["params"].get(p.name, "")) for p in d.params))))
    return sorted(out)


def shown(df):
    return sorted((r.eventType, r.txId, r.clauseIndex, tuple(sorted(r.params.items()))) for r in df.collect())


@pytest.mark.parametrize("definitions", [[ONE], [pair()], [pair(False)], [pair(rules=[Rule("a", "w", "b", "w", "LE")])], [pair(False, [Rule("a", "w", "b", "w", "NE")])], [pair(), ONE], [ONE, pair()], [pair(every_combination=True, rules=[Rule("a", "v", "b", "v", "LT")])], [Definition("Two", (Alias("A", "a"), Alias("A", "b")), (), (Taken("v", "a", "x"), Taken("v", "b", "y")), True)]])
def test_plans_equal_the_loop(spark, definitions):
    data = rows(120, len(definitions) + 5)
    assert shown(B.business_events(frame(spark, data), definitions)) == loop(data, definitions)


def test_general_equals_fast_paths(spark):
    data = rows(150, 9)
    for d in (ONE, pair(), pair(False)):
        assert shown(B.general(frame(spark, data), [d])) == shown(B.business_events(frame(spark, data), [d]))


def test_plan_choice():
    kinds = lambda ds: [k for k, _ in B.plan(ds)]
    assert kinds([ONE]) == ["single"] and kinds([pair()]) == ["ranked"] and kinds([pair(), ONE]) == ["general"]
    assert kinds([pair(every_combination=True)]) == ["general"] and kinds([Definition("None")]) == ["none"]


def test_an_earlier_definition_takes_first():
    data = [event("t", 0, 0, "A", v=5), event("t", 0, 1, "B", v=1)]
    assert [d.name for d, _ in B.match(data, [pair(), ONE])] == ["Pair"]
    assert [d.name for d, _ in B.match(data, [ONE, pair()])] == ["One"]


def test_matching_repeats_and_a_broken_rule_ends_it():
    data = [event("t", 0, i, k, v=v) for i, (k, v) in enumerate([("A", 1), ("B", 1), ("A", 2), ("B", 9), ("A", 3), ("B", 3)])]
    assert len(B.match(data, [pair()])) == 3
    assert len(B.match(data, [pair(rules=[Rule("a", "v", "b", "v", "EQ")])])) == 1


def test_a_null_in_a_rule_is_false_and_in_a_condition_empty():
    data = [event("t", 0, 0, "A"), event("t", 0, 1, "B")]
    assert not B.match(data, [pair(rules=[Rule("a", "v", "b", "v", "EQ")])])
    assert B.match(data, [Definition("E", (Alias("A", "a", (Condition("v", False, " ", True, "EQ"),)),))])


def test_two_aliases_of_one_name_never_match():
    assert not B.match([event("t", 0, 0, "A"), event("t", 0, 1, "A")], [Definition("D", (Alias("A", "a"), Alias("A", "a")))])


def test_exhaustive_search_ignores_conditions_and_is_bounded():
    data = [event("t", 0, i, "A", v=i) for i in range(9)]
    d = Definition("D", (Alias("A", "a", (Condition("v", False, "99", True, "EQ"),)), Alias("A", "b")), (Rule("a", "v", "b", "v", "GT"),), (), every_combination=True)
    assert not B.match(data, [d])  # the ten nodes end before a = 1 has a b
    wide = Definition("D", d.aliases, d.rules, (), every_combination=True, max_attempts=200)
    found = B.match(data, [wide])
    assert found and all(int(f["a"]["params"]["v"]) > int(f["b"]["params"]["v"]) for _, f in found)


def test_parameters_come_before_fields():
    assert B._find(event("t", 0, 0, "A", address="own"), "address") == "own"
    assert B._find(event("t", 0, 0, "A"), "address") == "0xC" and B._find(event("t", 0, 0, "A"), "paid") is None


def test_used_clauses_lose_their_plain_events(spark):
    data = [event("t", 0, 0, "A", v=5), event("t", 0, 1, "C"), event("t", 1, 2, "C"), event("u", 0, 3, "C")]
    all_ = frame(spark, data)
    out = combine.without_used(all_, B.business_events(all_, [ONE]))
    assert sorted((r.txId, r.clauseIndex, r.eventType) for r in out.collect()) == [("t", 0, "One"), ("t", 1, "C"), ("u", 0, "C")]


def test_no_events_give_no_rows(spark):
    assert B.business_events(frame(spark, []), [ONE, pair()]).count() == 0
    assert B.business_events(frame(spark, rows(5, 1)), []).where(F.lit(True)).count() == 0
