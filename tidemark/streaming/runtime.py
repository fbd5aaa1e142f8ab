"""Indexers: configuration, ordered processing, catch-up, reorganisation, scheduling.

A group of indexers that stand at about the same block is one streaming query;
each micro-batch goes to the group's indexers in dependency order. Catch-up reads
logs in wide ranges of many batches, each batch a task, up to the finalized block. A
reorganisation rolls the sinks back and starts the queries again from the new
positions. A step that fails is tried again with backoff; a query that dies of
anything else is started again from the sinks' positions.
"""

from __future__ import annotations

import enum
import logging
import re
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import business, chain, combine, events, registry
from tidemark.operators.schedule import Node, components, depends_on_any, merge_calls, proximity
from tidemark.session import shared_folder, ship
from tidemark.sources.chain import register
from tidemark.sources.client import PAGE, client

from .retry import Reorganised, Stopped, retry
from .sink import BlockId, Processor, Result

log = logging.getLogger(__name__)

#: Blocks of a log batch, blocks between progress messages, how near indexers run together, seconds between regroupings.
BATCH, PROGRESS, NEAR, REGROUP = 100, 1000, 500_000, 15 * 60


class Status(enum.Enum):
    NOT_INITIALISED = 0
    INITIALISED = 1
    FAST_SYNCING = 2
    SYNCING = 3
    FULLY_SYNCED = 4
    SHUT_DOWN = 5


def ensure(status: Status, *allowed: Status) -> None:
    if status is Status.SHUT_DOWN:
        raise Stopped("the indexer is shut down")
    if status not in allowed:
        raise ValueError(f"not possible while {status.name}")


@dataclass(frozen=True)
class Config:
    """What one indexer reads and keeps. ``source`` has the options of the chain source."""

    name: str
    source: Mapping[str, str]
    processor: Processor
    depends_on: str | None = None
    start: int = 0
    full_block: bool = False
    abis: tuple[registry.Abi, ...] = ()
    definitions: tuple[business.Definition, ...] = ()
    contracts: tuple[str, ...] = ()
    transfers: bool = False
    remove_duplicates: bool = True
    criteria: str = "[]"
    transfer_criteria: str = "[]"
    calls: tuple[tuple[str, str, str], ...] = ()
    batch: int = BATCH
    page: int = PAGE
    progress: int = PROGRESS
    width: int = 0  # batches of a catch-up step; 0: four for each core


class Builder:
    """Step by step to a BlockIndexer, for full blocks or a dependency, or a LogIndexer."""

    def __init__(self, name: str, source: Mapping[str, str], processor: Processor):
        self.own = Config(name, dict(source), processor)

    def _with(self, **kw) -> Builder:
        self.own = replace(self.own, **kw)
        return self

    def start(self, block: int) -> Builder:
        return self._with(start=block)

    def depends_on(self, name: str) -> Builder:
        return self._with(depends_on=name)

    def full_block(self) -> Builder:
        return self._with(full_block=True)

    def abis(self, folder: str, names: Sequence[str] = (), values: Mapping[str, str] | None = None) -> Builder:
        return self._with(abis=tuple(registry.load(folder, "event", names, values)))

    def business_events(self, folder: str, abi_folder: str, names: Sequence[str] = (), values: Mapping[str, str] | None = None) -> Builder:
        found = tuple(business.load(folder, names, values))
        needed = business.abi_names(found)
        more = registry.load(abi_folder, "event", needed, values) if needed else []
        return self._with(definitions=found, abis=tuple(registry.distinct([*self.own.abis, *more])))

    def contracts(self, *addresses: str) -> Builder:
        return self._with(contracts=addresses)

    def transfers(self) -> Builder:
        return self._with(transfers=True)

    def keep_duplicates(self) -> Builder:
        return self._with(remove_duplicates=False)

    def criteria(self, events: str = "[]", transfers: str = "[]") -> Builder:
        return self._with(criteria=events, transfer_criteria=transfers)

    def calls(self, *clauses: tuple[str, str, str]) -> Builder:
        """(to, value, data) of each call to simulate on every block."""
        return self._with(calls=clauses)

    def batch(self, blocks: int, page: int = PAGE, width: int = 0) -> Builder:
        """Blocks of a task of the catch-up, logs of a page, and tasks of a step."""
        if blocks < 1 or page < 1 or width < 0:
            raise ValueError("a batch and a page hold one or more")
        return self._with(batch=blocks, page=page, width=width)

    def progress_every(self, blocks: int) -> Builder:
        if blocks <= 0:
            raise ValueError("the interval must be over 0")
        return self._with(progress=blocks)

    def build(self) -> BlockIndexer | LogIndexer:
        c = self.own
        if c.calls and not c.full_block:
            raise ValueError("calls need full blocks")
        return BlockIndexer(c) if c.full_block or c.depends_on else LogIndexer(c)


class BlockIndexer:
    """Keeps its place in the chain, checks each run of blocks against it, and hands results to its sink."""

    def __init__(self, config: Config, now: Callable[[], float] = time.time):
        self.config, self.now = config, now
        self.status, self.current, self.previous = Status.NOT_INITIALISED, config.start, None
        self.processed_at: float | None = None

    @property
    def name(self) -> str:
        return self.config.name

    @property
    def node(self) -> Node:
        return Node(self.name, self.config.depends_on, self.current)

    def initialise(self) -> None:
        """Go back to the last block that the sink has, which is processed again."""
        if self.status is Status.SHUT_DOWN:
            raise Stopped(self.name)
        sink = self.config.processor
        last = sink.last_synced()
        at = last.number if last else self.config.start
        if at > 0:
            sink.rollback(at)
            last = sink.last_synced()
        self.current = at
        self.previous = last if last and last.number == at - 1 and last.id else None
        self.status = Status.INITIALISED

    def shutdown(self) -> None:
        self.status = Status.SHUT_DOWN

    def decode(self, blocks: DataFrame) -> DataFrame:
        c = self.config
        rows = events.block_events(blocks) if c.abis else None
        transfers = events.block_transfers(blocks) if c.transfers or business.needs_transfers(c.definitions) else None
        out = combine.process(rows, transfers, c.abis, c.definitions, c.contracts, c.transfers, c.remove_duplicates)
        return out if out is not None else events.block_transfers(blocks).limit(0)

    def process(self, blocks: DataFrame, calls: DataFrame | None = None) -> None:
        """One run of whole blocks. Those before the current one are skipped; a gap is an error."""
        ensure(self.status, Status.INITIALISED, Status.SYNCING, Status.FULLY_SYNCED)
        blocks = chain.pending(blocks, self.current)
        edge = blocks.agg(F.min("number"), F.max("number"), F.count(F.lit(1)), F.min_by("parentID", "number"), F.max_by("id", "number"), F.max_by("timestamp", "number")).first()
        first, last, n, parent, tip, stamp = edge
        if not n:
            return
        if first != self.current or last - first + 1 != n:
            raise ValueError(f"{self.name} is at block {self.current} and got {n} blocks from {first} to {last}")
        torn = first > self.config.start and self.previous is not None and self.previous.id != parent
        if torn or chain.reorganised(blocks, self.config.start).head(1):
            self.config.processor.rollback(max(self.current - 1, 0))
            raise Reorganised(f"{self.name} at block {first}: the parent is not the block before")
        self.status = Status.FULLY_SYNCED if self.now() - stamp < chain.RECENT_SECONDS else Status.SYNCING
        if self.status is Status.FULLY_SYNCED or first // self.config.progress != (last + 1) // self.config.progress:
            log.info("%s is at block %d (%s)", self.name, last, self.status.name)
        self.config.processor.process(Result(first, BlockId(last, tip), self.decode(blocks), self.status.name, blocks if self.config.full_block else None, calls))
        self.previous, self.current, self.processed_at = BlockId(last, tip), last + 1, self.now()


class LogIndexer(BlockIndexer):
    """Catches up by scans of logs in batches of blocks; near the tip it goes by blocks like the others."""

    def fast_sync(self, spark: SparkSession, interrupted: Callable[[], bool] = lambda: False) -> None:
        """Up to the finalized block, that one too. A step reads ``width`` batches at once, each in a task of its own."""
        ensure(self.status, Status.INITIALISED, Status.FAST_SYNCING)
        own = client(self.config.source)
        target = own.block("finalized", False)
        self.status = Status.FAST_SYNCING
        step = self.config.batch * (self.config.width or 4 * spark.sparkContext.defaultParallelism)
        while self.current <= target["number"]:
            if self.status is Status.SHUT_DOWN:
                raise Stopped(self.name)
            if interrupted():
                break
            end = min(self.current + step - 1, target["number"])
            self._batch(spark, self.current, end, target)
        self.status = Status.INITIALISED

    def _scan(self, spark: SparkSession, mode: str, first: int, last: int, criteria: str) -> DataFrame:
        options = {**self.config.source, "mode": mode, "startBlock": str(first), "endBlock": str(last), "criteria": criteria, "logFetchLimit": str(self.config.page), "blockBatchSize": str(self.config.batch)}
        return spark.read.format("chain").options(**options).load()

    def _batch(self, spark: SparkSession, first: int, last: int, target: Mapping) -> None:
        c = self.config
        rows = self._scan(spark, "events", first, last, c.criteria).cache() if c.abis else None
        moved = self._scan(spark, "transfers", first, last, c.transfer_criteria).cache() if c.transfers or business.needs_transfers(c.definitions) else None
        here = BlockId(last, target["id"] if last == target["number"] else None)
        if any(x is not None and x.head(1) for x in (rows, moved)):
            out = combine.process(events.log_events(rows) if rows is not None else None, events.log_transfers(moved) if moved is not None else None, c.abis, c.definitions, c.contracts, c.transfers, c.remove_duplicates)
            if out is not None:
                c.processor.process(Result(first, here, out, self.status.name))
        else:
            c.processor.advance(here, self.status.name)
        for x in (rows, moved):
            if x is not None:
                x.unpersist()
        self.current, self.previous = last + 1, here if here.id else None


class Runner:
    """Runs indexers over one source until stopped, or until the best block if ``once``."""

    def __init__(self, spark: SparkSession, indexers: Sequence[BlockIndexer], checkpoints: str | None = None, near: int = NEAR, regroup: float = REGROUP, blocks: int = 1, attempts: int | None = None, sleep: Callable[[float], None] = time.sleep):
        """``attempts`` bounds the tries of a step, and the restarts in a row without a new block; None: until it works."""
        if not indexers:
            raise ValueError("there is nothing to run")
        if blocks < 1:
            raise ValueError("a batch holds one block or more")
        self.spark, self.indexers, self.near, self.regroup, self.blocks = register(ship(spark)), list(indexers), near, regroup, blocks
        self.checkpoints = checkpoints or f"{shared_folder(spark)}/tidemark/streams"
        self.attempts, self.sleep = attempts, sleep
        self.stopping = False
        components([i.node for i in self.indexers])

    def stop(self) -> None:
        self.stopping = True
        for i in self.indexers:
            i.shutdown()

    def initialise(self, some: Sequence[BlockIndexer]) -> None:
        with ThreadPoolExecutor(max(1, len(some))) as pool:
            list(pool.map(lambda i: self._try(i.initialise), some))

    def _try(self, call: Callable):
        """With backoff, but for what trying again doesn't help."""
        return retry(call, passes=(Reorganised, Stopped, ValueError), attempts=self.attempts, sleep=self.sleep)

    def _positions(self) -> list[int]:
        return [i.current for i in self.indexers]

    def run(self, once: bool = False) -> None:
        failed, delay = 0, 1.0
        while not self.stopping:
            before = self._positions()
            try:
                self._catch_up(once)
                self.initialise([i for i in self.indexers if not isinstance(i, LogIndexer)])
                self._tail(once)
                if once:
                    return
            except Reorganised as e:
                log.warning("%s; starting again", e)
            except Stopped:
                if not self.stopping:
                    raise
            except Exception as e:
                failed = 1 if self._positions() != before else failed + 1
                if self.attempts is not None and failed >= self.attempts:
                    raise
                delay = min(30.0, 2.0**failed)
                log.warning("%s; starting again in %.0f s", e, delay)
                self.sleep(delay)

    def _catch_up(self, once: bool) -> None:
        """Catch-up of those that can, each in its own thread; the others, unless they need one of these, run on meanwhile.

        If their queries fail or meet a reorganisation, the catch-up is interrupted and all start again.
        """
        fast = [i for i in self.indexers if isinstance(i, LogIndexer)]
        self.initialise(fast)
        if not fast:
            return
        names, nodes = {i.name for i in fast}, [i.node for i in self.indexers]
        free = [i for i in self.indexers if i.name not in names and not depends_on_any(i.node, names, nodes)]
        torn: list[Exception] = []
        with ThreadPoolExecutor(len(fast)) as pool:
            work = [pool.submit(self._try, lambda i=i: i.fast_sync(self.spark, lambda: bool(torn))) for i in fast]
            if free and not once:
                queries = []
                try:
                    self.initialise(free)
                    queries = self._start(free, False)
                    while not all(w.done() for w in work) and all(q.isActive for q in queries):
                        time.sleep(0.2)
                except Exception as e:
                    torn.append(e)
                finally:
                    for q in queries:
                        q.stop()
                    torn += [q.exception() for q in queries if q.exception() is not None]
            for w in work:
                w.result()
        if torn:
            raise _cause(torn[0])

    def _start(self, some: Sequence[BlockIndexer], once: bool) -> list:
        by_name = {i.name: i for i in some}
        nodes = [replace(i.node, depends_on=i.node.depends_on if i.node.depends_on in by_name else None) for i in some]
        return [self._query([by_name[n.name] for n in group], once) for group in proximity(nodes, self.near)]

    def _query(self, group: Sequence[BlockIndexer], once: bool):
        """One streaming query; its start is the first position of the group."""
        first = min(i.current for i in group)
        calls, index = merge_calls([i.config.calls for i in group])
        options = {**group[0].config.source, "mode": "blocks", "startBlock": str(first), "blockBatchSize": str(max(1, self.blocks // 8))}
        if not once:
            options["maxBlocksPerTrigger"] = str(self.blocks)
        rows = self.spark.readStream.format("chain").options(**options).load()

        def step(batch: DataFrame, _: int) -> None:
            batch = batch.persist()
            try:
                results = inspect(batch, group[0].config.source, calls) if calls else None
                for i, own in zip(group, index, strict=True):
                    self._try(lambda i=i, own=own: i.process(batch, chain.with_inspections(batch, results, own) if results is not None and own else None))
            finally:
                batch.unpersist()

        write = rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.checkpoints}/{uuid.uuid4().hex}")
        return (write.trigger(availableNow=True) if once else write.trigger(processingTime="3 seconds")).start()

    def _tail(self, once: bool) -> None:
        """The queries of all groups; after the interval the groups are formed anew from where their indexers stand."""
        while not self.stopping:
            queries = self._start(self.indexers, once)
            began = time.time()
            try:
                while not self.stopping and all(q.isActive for q in queries):
                    queries[0].awaitTermination(0.2)
                    if not once and len(queries) > 1 and time.time() - began > self.regroup:
                        break
                if once:
                    for q in queries:
                        q.awaitTermination()
            except Exception as e:
                raise _cause(e) from e
            finally:
                for q in queries:
                    q.stop()
            for q in queries:
                if q.exception() is not None:
                    raise _cause(q.exception())
            if once:
                return


def _cause(e: Exception) -> Exception:
    """A reorganisation that a query died of, as itself. The name of the class alone may stand in any traceback."""
    found = re.search(r"retry\.Reorganised: (.*)", str(e))
    return Reorganised(found[1]) if found else e


def inspect(blocks: DataFrame, source: Mapping[str, str], calls: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(blockId, results): the calls simulated on each block, asked for by the tasks."""
    options, clauses = dict(source), [{"to": to, "value": value, "data": data} for to, value, data in calls]

    def run(batches):
        import pandas as pd

        own = client(options)
        for batch in batches:
            rows = [(b, retry(lambda b=b: own.inspect(clauses, b), attempts=5)) for b in batch["id"]]
            yield pd.DataFrame([(b, [dict(x) for x in r]) for b, r in rows], columns=["blockId", "results"])

    schema = "blockId string, results array<struct<data: string, gasUsed: bigint, reverted: boolean, vmError: string>>"
    return blocks.select("id").mapInPandas(run, schema)
