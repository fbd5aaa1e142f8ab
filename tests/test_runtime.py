"""Catch-up, tail, reorganisation and rollback over a folder of blocks."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import combine, events
from tidemark.operators.registry import Abi, Param
from tidemark.sources import client as C
from tidemark.sources import lookup
from tidemark.sources.chain import register
from tidemark.streaming import retry as R
from tidemark.streaming.runtime import BlockIndexer, Builder, LogIndexer, Runner, Status
from tidemark.streaming.sink import TableProcessor

ABI = Abi("Moved", "event", (Param("from", "address", True), Param("value", "uint256")))


def block(n, parent=None, tag=""):
    word = lambda x: "0x" + f"{x:064x}"
    output = {"contractAddress": None, "events": [{"address": "0x" + "c" * 40, "topics": ["0x" + ABI.signature, word(n)], "data": word(n * 7)}] * (n % 3), "transfers": [{"sender": "0x1", "recipient": "0x2", "amount": hex(n)}]}
    tx = {"id": f"t{n}{tag}", "origin": "0xA", "gasPayer": "0xA", "paid": "0x1", "gasUsed": 1, "outputs": [output], "reverted": False}
    return {"number": n, "id": f"b{n}{tag}", "parentID": parent or f"b{n - 1}", "timestamp": n * 10, "transactions": [tx]}


@pytest.fixture
def node(tmp_path):
    at = tmp_path / "node"
    (at / "blocks").mkdir(parents=True)
    for n in range(31):
        (at / "blocks" / f"{n}.json").write_text(json.dumps(block(n)))
    return at


def put(node, b):
    (node / "blocks" / f"{b['number']}.json").write_text(json.dumps(b))


def source(node, finalized=20):
    return {"path": str(node), "finalized": str(finalized)}


def built(spark, node, tmp_path, name="one", full=False, **kw):
    sink = TableProcessor(spark, f"file://{tmp_path}/{name}", name)
    b = Builder(name, source(node, **kw), sink).transfers().batch(7, 5)
    b.own = b._with(abis=(ABI,)).own
    return (b.full_block() if full else b).build(), sink


def seen(sink):
    return sorted((r.blockNumber, r.eventType, r["count"]) for r in sink.events().groupBy("blockNumber", "eventType").count().collect())


def expected(last, first=0):
    return sorted([(n, "Moved", n % 3) for n in range(first, last + 1) if n % 3] + [(n, "VET_TRANSFER", 1) for n in range(first, last + 1)])


def test_batch_source(spark, node):
    register(spark)
    read = lambda mode, **o: spark.read.format("chain").options(mode=mode, path=str(node), blockBatchSize="4", **o).load()
    assert read("blocks").count() == 31
    assert sorted(r.number for r in read("blocks").where("number >= 5 AND number < 9").collect()) == [5, 6, 7, 8]
    assert read("compressed", startBlock="3", endBlock="3").first().transactions == ["t3"]
    assert read("events", endBlock="10", logFetchLimit="2").count() == sum(n % 3 for n in range(11))
    assert read("transfers", criteria=json.dumps([{"sender": "0X1"}])).count() == 31
    assert read("transfers").where("sender = '0x9'").count() == 0


def test_lookups_and_criteria(spark, node, tmp_path):
    df = spark.createDataFrame([("0x1", 1), ("0x1", 2), (None, 3)], "who string, n int")
    got = sorted((r.n, r.balance, r.hasCode) for r in lookup.with_accounts(df, "who", {"path": str(node)}).collect())
    assert got == [(1, "0x0", False), (2, "0x0", False), (3, None, None)]
    assert {r.code for r in lookup.with_code(df, "who", {"path": str(node)}).collect()} == {"0x", None}
    register(spark)
    logs = spark.read.format("chain").options(mode="events", path=str(node)).load()
    moves = spark.read.format("chain").options(mode="transfers", path=str(node)).load()
    every = events.decode(events.log_events(logs), [ABI]).unionByName(events.log_transfers(moves))
    assert combine.Criteria(("Moved",)).apply(every).count() == logs.count()
    assert combine.Criteria(contracts=("0x" + "C" * 40,), transfers=True).apply(every).count() == logs.count() + 31
    assert combine.Criteria(("A", "B"), ("B", "C")).names == ["A", "B", "C"]


def test_client_pages_and_waits(node):
    own = C.FileClient(str(node), 20)
    assert own.block("best")["number"] == 30 and own.block("finalized")["number"] == 20
    assert len(list(C.drain(own, "event", 0, 30, limit=4))) == sum(n % 3 for n in range(31))
    naps = []
    with pytest.raises(InterruptedError):
        C.wait_for(own, 99, stopped=lambda: len(naps) == 2, sleep=naps.append)
    assert naps == [C.POLL, C.POLL]
    with pytest.raises(R.BlockNotFound):
        own.block(99)


def test_fast_sync_up_to_the_finalized_block(spark, node, tmp_path):
    one, sink = built(spark, node, tmp_path)
    assert isinstance(one, LogIndexer)
    register(spark)
    one.initialise()
    one.fast_sync(spark)
    assert one.current == 21 and seen(sink) == expected(20)
    assert sink.last_synced().number == 20 and sink.last_synced().id == "b20"


def test_run_to_the_tip_and_on(spark, node, tmp_path):
    one, sink = built(spark, node, tmp_path)
    two, other = built(spark, node, tmp_path, "two", full=True)
    assert isinstance(two, BlockIndexer) and not isinstance(two, LogIndexer)
    Runner(spark, [one, two], f"file://{tmp_path}/check").run(once=True)
    assert seen(sink) == expected(30) and seen(other) == expected(30)
    assert one.current == two.current == 31
    put(node, block(31))
    three, sink = built(spark, node, tmp_path, "two", full=True)
    Runner(spark, [three], f"file://{tmp_path}/check").run(once=True)
    assert seen(sink) == expected(31)


def test_reorganisation_rolls_back_and_starts_again(spark, node, tmp_path):
    one, sink = built(spark, node, tmp_path, full=True)
    Runner(spark, [one], f"file://{tmp_path}/check").run(once=True)
    for b in (block(29, "b28", "x"), block(30, "b29x", "x"), block(31, "b30x")):
        put(node, b)
    runner = Runner(spark, [one], f"file://{tmp_path}/check")
    runner.run(once=True)
    assert seen(sink) == expected(31)
    assert {r.blockId for r in sink.events().where(F.col("blockNumber") >= 29).collect()} == {"b29x", "b30x", "b31"}


def test_gaps_and_states(spark, node, tmp_path):
    one, _ = built(spark, node, tmp_path, full=True)
    some = spark.read.format("chain").options(path=str(node), startBlock="2", endBlock="3").load()
    with pytest.raises(ValueError):
        one.process(some)
    one.initialise()
    with pytest.raises(ValueError, match="is at block 0"):
        one.process(some)
    one.shutdown()
    assert one.status is Status.SHUT_DOWN
    with pytest.raises(R.Stopped):
        one.initialise()


def test_builder_checks():
    b = Builder("x", {}, None)
    for bad in (lambda: b.batch(0), lambda: b.progress_every(0), lambda: Builder("x", {}, None).calls(("0x1", "0x0", "0x")).build()):
        with pytest.raises(ValueError):
            bad()
    assert isinstance(Builder("x", {}, None).depends_on("y").build(), BlockIndexer)
    with pytest.raises(ValueError):
        Runner(None, [])


def test_retry_backs_off():
    naps, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 8:
            raise OSError("no")
        return "yes"

    assert R.retry(call, sleep=naps.append) == "yes"
    for nap, base in zip(naps, [1, 2, 4, 8, 16, 30, 30], strict=True):
        assert base <= nap <= 2 * base
    with pytest.raises(R.Reorganised):
        R.retry(lambda: (_ for _ in ()).throw(R.Reorganised("x")), sleep=naps.append)


class Counting(C.FileClient):
    """A folder that notes its calls and fails at those that a test names."""

    def __init__(self, folder, finalized=None):
        super().__init__(folder, finalized)
        self.asked, self.bad = [], []

    def block(self, revision, expanded=True):
        if self.bad:
            raise self.bad.pop()
        return super().block(revision, expanded)

    def logs(self, kind, first, last, offset=0, limit=C.PAGE, criteria=()):
        self.asked.append((first, last, offset, limit))
        return super().logs(kind, first, last, offset, limit, criteria)


def test_options_in_any_case(spark, node):
    from tidemark.sources.chain import Options

    for keys in (("startBlock", "blockBatchSize", "logFetchLimit", "maxBlocksPerTrigger", "endBlock"), ("startblock", "blockbatchsize", "logfetchlimit", "maxblockspertrigger", "endblock")):
        o = Options.of({**dict(zip(keys, "34567", strict=True)), "Path": "x"})
        assert (o.first, o.batch, o.page, o.most, o.last) == (3, 4, 5, 6, 7) and o.node["path"] == "x"
    for bad in ({"mode": "x"}, {"startBlock": "-1"}, {"blockBatchSize": "0"}, {"maxBlocksPerTrigger": "0"}, {"logFetchLimit": "0"}):
        with pytest.raises(ValueError):
            Options.of(bad)
    register(spark)
    read = lambda **o: spark.read.format("chain").options(path=str(node), **o).load()
    assert read(blockBatchSize="4").rdd.getNumPartitions() == 8 and read(blockBatchSize="4", startBlock="29").rdd.getNumPartitions() == 1
    assert sorted(r.number for r in read(startBlock="28").collect()) == [28, 29, 30]


def test_page_sizes_reach_the_node(node, monkeypatch):
    from tidemark.sources import chain as S

    own = Counting(str(node))
    monkeypatch.setattr(S, "client", lambda _: own)
    o = S.Options.of({"mode": "events", "logFetchLimit": "4", "blockBatchSize": "10"})
    assert [(p.first, p.last) for p in o.parts(0, 30)] == [(0, 9), (10, 19), (20, 29), (30, 30)]
    assert len(list(S._read(o, S.Range(0, 9)))) == 9
    assert own.asked == [(0, 9, 0, 4), (0, 9, 4, 4), (0, 9, 8, 4)]


def test_stream_takes_bounded_batches_and_goes_on_after_a_restart(spark, node, tmp_path):
    register(spark)
    got = []
    for last in (30, 33):
        for n in range(31, last + 1):
            put(node, block(n))
        rows = spark.readStream.format("chain").options(path=str(node), startBlock="10", maxBlocksPerTrigger="5", blockBatchSize="2").load()
        query = rows.writeStream.foreachBatch(lambda df, i: got.append((sorted(r.number for r in df.collect()), df.rdd.getNumPartitions()))).option("checkpointLocation", f"file://{tmp_path}/check").start()
        for _ in range(600):
            if sum(len(g) for g, _ in got) >= last - 9:
                break
            query.awaitTermination(0.1)
        query.stop()
    # the batch during which the first query was stopped may come again
    assert list(dict.fromkeys(n for g, _ in got for n in g)) == list(range(10, 34))
    assert all(len(g) <= 5 and parts <= 3 for g, parts in got) and len(got) >= 6


def test_stream_waits_while_the_node_has_no_newest_block(node, monkeypatch):
    from tidemark.sources import chain as S

    own, clock = Counting(str(node)), [1000.0]
    monkeypatch.setattr(S, "client", lambda _: own)
    r = S.ChainStream(S.Options.of({"startBlock": "28", "maxBlocksPerTrigger": "2"}), now=lambda: clock[0])
    for bad, nap in ((R.BlockNotFound("x"), C.POLL), (R.RateLimited("x"), C.LIMITED), (OSError("x"), C.ERROR)):
        own.bad = [bad]
        assert r.latestOffset() == {"block": 28} and r.pause == clock[0] + nap
        assert r.latestOffset() == {"block": 28}  # not asked again before the pause is over
        clock[0] += nap
    assert r.latestOffset() == {"block": 30} and r.latestOffset() == {"block": 31}
    assert r.stamp == 300  # at the tip the window is as many blocks as the time since allows


def test_block_reads_are_tried_again(node, monkeypatch):
    from tidemark.sources import chain as S

    own = Counting(str(node))
    own.bad = [OSError("x"), R.RateLimited("x")]
    monkeypatch.setattr(S, "client", lambda _: own)
    monkeypatch.setattr(R, "nap", lambda _: None)
    assert [x[0] for x in S._read(S.Options.of({}), S.Range(1, 2))] == [1, 2]
    own.bad = [OSError("x")] * 9
    with pytest.raises(OSError):
        list(S._read(S.Options.of({"retries": "2"}), S.Range(1, 2)))


class Failing(TableProcessor):
    """A table that fails a few times."""

    def __init__(self, *a, times=2, error=OSError):
        super().__init__(*a)
        self.left, self.error, self.tries = times, error, 0

    def process(self, result):
        self.tries += 1
        if self.left:
            self.left -= 1
            raise self.error("the sink is away")
        super().process(result)


def test_a_step_that_fails_is_tried_again(spark, node, tmp_path):
    naps = []
    sink = Failing(spark, f"file://{tmp_path}/x", "x")
    b = Builder("x", source(node), sink).transfers().full_block()
    one = b._with(abis=(ABI,)).build()
    Runner(spark, [one], f"file://{tmp_path}/check", sleep=naps.append).run(once=True)
    assert seen(sink) == expected(30) and len(naps) == 2 and sink.tries >= 3
    sink = Failing(spark, f"file://{tmp_path}/y", "y", times=99)
    b = Builder("y", source(node), sink).full_block()
    with pytest.raises(Exception, match="away"):
        Runner(spark, [b.build()], f"file://{tmp_path}/check", attempts=2, sleep=naps.append).run(once=True)


def test_a_query_that_dies_starts_again(spark, node, tmp_path):
    """An error that a step doesn't try again ends the query; the runner starts it from the sink's position."""
    sink = Failing(spark, f"file://{tmp_path}/z", "z", times=1, error=ValueError)
    one = Builder("z", source(node), sink).transfers().full_block().build()
    naps = []
    Runner(spark, [one], f"file://{tmp_path}/check", sleep=naps.append).run(once=True)
    assert sorted(r.blockNumber for r in sink.events().collect()) == list(range(31)) and naps


def test_rollback_keeps_what_is_before_it_even_if_broken_off(spark, node, tmp_path, monkeypatch):
    one, sink = built(spark, node, tmp_path, full=True)
    Runner(spark, [one], f"file://{tmp_path}/check").run(once=True)
    monkeypatch.setattr(sink, "_delete", lambda at: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        sink.rollback(11)
    monkeypatch.undo()
    assert set(expected(10)) <= set(seen(sink))  # nothing before the block is lost
    sink.rollback(11)
    assert seen(sink) == expected(10) and sink.last_synced().number == 10
    one.initialise()
    assert one.current == 10 and seen(sink) == expected(9)
    for n in range(60):
        sink.advance(sink.last_synced(), "SYNCING")
    assert len(sink._positions()) == 1


def test_intermediate_reorganisation_restarts_everything(spark, node, tmp_path):
    """While one indexer catches up, the query of another meets a wrong parent."""
    slow, sink = built(spark, node, tmp_path)
    free, other = built(spark, node, tmp_path, "two", full=True)
    runner = Runner(spark, [slow, free], f"file://{tmp_path}/check", blocks=50)
    held = LogIndexer._batch
    went = []

    def batch(self, *a):
        if not went:
            went.append(1)
            for _ in range(300):  # until the other one is at work
                if free.current > 25:
                    break
                R.time.sleep(0.1)
            for b in (block(29, "b28", "x"), block(30, "b29x", "x"), block(31, "b30x")):
                put(node, b)
            for _ in range(200):
                if free.status is Status.INITIALISED:
                    break
                R.time.sleep(0.1)
        return held(self, *a)

    calls = []
    start = runner._start
    runner._start = lambda some, once: calls.append([i.name for i in some]) or start(some, once)
    import threading

    LogIndexer._batch = batch
    try:
        t = threading.Thread(target=runner.run)
        t.start()
        for _ in range(900):
            if slow.current == free.current == 32:
                break
            R.time.sleep(0.1)
        runner.stop()
        t.join(60)
    finally:
        LogIndexer._batch = held
    assert seen(sink) == seen(other) == expected(31)
    assert {r.blockId for r in other.events().where(F.col("blockNumber") >= 29).collect()} == {"b29x", "b30x", "b31"}


def test_a_folder_is_not_listed_for_each_block_or_page(node, monkeypatch):
    """What a block or a short range costs doesn't grow with the folder, and the pages of a scan open each block once."""
    own, listed, opened = C.FileClient(str(node), 20), [], []
    numbers, read = own._numbers, own._block
    monkeypatch.setattr(own, "_numbers", lambda: listed.append(1) or numbers())
    monkeypatch.setattr(own, "_block", lambda n: opened.append(n) or read(n))
    assert own.block(5)["number"] == 5 and own.block("finalized")["number"] == 20 and not listed
    opened.clear()
    got = [x["meta"]["blockNumber"] for page in C.pages(own, "event", 3, 9, 2) for x in page]
    assert got == [n for n in range(3, 10) for _ in range(n % 3)] and opened == list(range(3, 10)) and not listed
    # a page out of turn, or of another scan, is read from the start
    every = [x["topics"] for x in own.logs("event", 3, 9)]
    assert [x["topics"] for x in own.logs("event", 3, 9, 4, 2)] == every[4:6] and [x["topics"] for x in own.logs("event", 3, 9, 2, 2)] == every[2:4]
    assert [x["meta"]["blockNumber"] for x in own.logs("event", 4, 9, 4, 9)] == [8, 8]
    # long ranges are listed; gaps and ends past the newest block are no error
    (node / "blocks" / "7.json").unlink()
    for most in (C.PROBES, 0):
        monkeypatch.setattr(C, "PROBES", most)
        assert [x["meta"]["blockNumber"] for x in own.logs("transfer", 6, 10**12 if not most else 99)] == [6, *range(8, 31)]


def test_the_newest_block_is_found_again_only_after_a_change(node, monkeypatch):
    import os

    own, listed = C.FileClient(str(node)), []
    numbers = own._numbers
    monkeypatch.setattr(own, "_numbers", lambda: listed.append(1) or numbers())
    # a folder that has just changed may change again within the same tick of its clock
    assert own.block("best")["number"] == 30 and own.block("best")["number"] == 30 and len(listed) == 2
    os.utime(node / "blocks", (1, 1))
    assert {own.block("best")["number"] for _ in range(9)} == {30} and len(listed) == 3
    put(node, block(31))
    assert own.block("best")["number"] == 31
    (node / "blocks" / "31.json").unlink()
    assert own.block("best")["number"] == 30


def test_the_plan_of_a_stream_is_made_once(spark, monkeypatch):
    from tidemark.plans import queries

    calls, made = [], events.block_transfers
    monkeypatch.setattr(events, "block_transfers", lambda blocks: calls.append(1) or made(blocks))
    at = "/root/testdata/sf0.01"
    first = spark.read.parquet(f"{at}/supplier.parquet").agg(F.min("s_suppkey")).first()[0]
    rows = queries.chain_stream(spark, at).collect()
    assert len(calls) == 1 and len(rows) == 100 and all(r.turn == (r.block - first) // 25 for r in rows)


def test_blocks_of_the_queries_are_where_executors_see_them(spark):
    from tidemark.plans import queries

    at = queries._node(spark, "/root/testdata/sf0.001")
    assert at.startswith(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) and C.FileClient(at).block("best")
