import pytest
from pyspark.sql import functions as F

from tidemark.operators import chain, schedule
from tidemark.operators.schedule import Node
from tidemark.plans import queries
from tidemark.sources.revision import Revision


def blocks(spark, pairs):
    return spark.createDataFrame([(n, f"b{n}", p, n * 10) for n, p in pairs], "number long, id string, parentID string, timestamp long")


def test_reorganisation_across_buckets(spark):
    df = blocks(spark, [(8, "b7"), (9, "b8"), (10, "b9"), (11, "fork"), (13, "b11")])
    for bucket in (2, 10, 1000):
        assert [r.number for r in chain.reorganised(df, bucket=bucket).collect()] == [11]
        assert [r.number for r in chain.gaps(df, bucket=bucket).collect()] == [13]
    assert chain.reorganised(df, start=11).count() == 0


def test_windows_and_status(spark):
    df = spark.createDataFrame([(None, 5), (95, 10), (-400, 8), (65, 10)], "last long, most long")
    got = [r[0] for r in df.select(chain.prefetch(F.col("last"), 100, F.col("most"))).collect()]
    assert got == [5, 1, 8, 4]
    row = spark.range(1).select(chain.status(F.lit(86), 100), chain.status(F.lit(85), 100), chain.batch(F.lit(105), 5, 100), chain.batch_end(F.lit(105), 100, 150)).first()
    assert tuple(row) == ("FULLY_SYNCED", "SYNCING", 1, 150)
    with pytest.raises(ValueError):
        chain.progress(df, 0, 1)


def test_prefetch_query_covers_later_events(spark):
    """Events after 'now' have a row of one block, or what is left of the most."""
    at = "/root/testdata/sf0.001"
    want = {}
    for i, t in spark.read.parquet(f"{at}/events.parquet").select("event_id", F.unix_timestamp("ts")).collect():
        want[i] = i % 20 if i % 11 == 0 else min(i % 20, max((1706000000 - t) // 10, 0) + 1)
    rows = queries.prefetch_window(spark, at).collect()
    assert len(rows) == len(want) and {r.event_id: r.size for r in rows} == want


def names(groups):
    return [[n.name for n in g] for g in groups]


def test_topological_order_and_errors():
    nodes = [Node("c", "b"), Node("a"), Node("b", "a"), Node("z")]
    assert [n.name for n in schedule.topological(nodes)] == ["a", "b", "c", "z"]
    assert names(schedule.components(nodes)) == [["a", "b", "c"], ["z"]]
    with pytest.raises(ValueError, match="circular"):
        schedule.topological([Node("a", "b"), Node("b", "a")])
    with pytest.raises(ValueError, match="isn't there"):
        schedule.topological([Node("a", "x")])
    assert schedule.depends_on_any(nodes[0], {"a"}, nodes) and not schedule.depends_on_any(nodes[3], {"a"}, nodes)


def test_proximity_keeps_chains_whole():
    nodes = [Node("a", None, 0), Node("b", None, 50), Node("c", None, 1000), Node("d", "a", 1010), Node("e", None, 5000)]
    assert names(schedule.by_gap(nodes, 100)) == [["a", "b"], ["c", "d"], ["e"]]
    got = sorted(sorted(g) for g in names(schedule.proximity(nodes, 100)))
    assert got == [["a", "b", "d"], ["c"], ["e"]]
    assert schedule.proximity([], 5) == []


def test_calls_are_merged_by_first_use():
    calls, index = schedule.merge_calls([["x", "y"], [], ["y", "z", "y"]])
    assert calls == ["x", "y", "z"] and index == [[0, 1], [], [1, 2, 1]]
    assert schedule.pick(["X", "Y", "Z"], index[2]) == ["Y", "Z", "Y"]


def test_revisions():
    assert Revision.parse(" BEST ") == Revision("keyword", "best")
    assert Revision.parse("007") == Revision("number", "7")
    assert Revision.parse("0x" + "AB" * 32) == Revision("id", "0x" + "ab" * 32)
    for bad in ("", "-1", "0x12", "latest"):
        with pytest.raises(ValueError, match="finalized"):
            Revision.parse(bad)
