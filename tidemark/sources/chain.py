"""``spark.read.format("chain")`` and ``spark.readStream.format("chain")``.

Options, in any case: ``mode`` (blocks, compressed, events, transfers), ``url`` or
``path``, ``startBlock``, ``endBlock``, ``blockBatchSize`` (100 blocks a partition),
``logFetchLimit`` (1,000 logs a page), ``criteria`` (JSON list), ``until`` (best
or finalized), ``maxBlocksPerTrigger``. A stream's offset is the next block
number. Filters on the block number narrow the range of a batch read, filters on
the address and the sender and recipient go to the node as criteria.

Reads of blocks and pages are tried ``retries`` times (5). While the node can't tell
its newest block, a stream has nothing new and asks again after a pause, longer
after an error or when the node limits calls.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tidemark.operators.chain import prefetch_size
from tidemark.schemas import BLOCK, BLOCK_COMPRESSED, EVENT_LOG, TRANSFER_LOG
from tidemark.streaming.retry import BlockNotFound, RateLimited, retry

from .client import ERROR, LIMITED, PAGE, POLL, Client, client, pages

log = logging.getLogger(__name__)

BATCH, RETRIES = 100, 5

_SCHEMAS = {"blocks": BLOCK, "compressed": BLOCK_COMPRESSED, "events": EVENT_LOG, "transfers": TRANSFER_LOG}


@dataclass
class Range(InputPartition):
    first: int
    last: int
    criteria: str = "[]"


@dataclass(frozen=True)
class Options:
    """The options of a read, with Spark's lower-case keys or any other."""

    node: Mapping[str, str] = field(repr=False)
    mode: str = "blocks"
    first: int = 0
    last: int | None = None
    batch: int = BATCH
    page: int = PAGE
    criteria: str | None = None
    until: str = "best"
    most: int | None = None
    retries: int = RETRIES

    @classmethod
    def of(cls, given: Mapping[str, str]) -> Options:
        low = {k.lower(): v for k, v in dict(given).items()}
        number = lambda k, default: int(low[k]) if k in low else default
        out = cls(low, low.get("mode", "blocks"), number("startblock", 0), number("endblock", None), number("blockbatchsize", BATCH), number("logfetchlimit", PAGE), low.get("criteria"), low.get("until", "best"), number("maxblockspertrigger", None), number("retries", RETRIES))
        if out.mode not in _SCHEMAS:
            raise ValueError(f"no such mode: {out.mode}")
        if out.first < 0 or out.batch < 1 or out.page < 1 or (out.most is not None and out.most < 1):
            raise ValueError("the first block is 0 or more; a batch, a page and a trigger hold one or more")
        return out

    @property
    def schema(self) -> T.StructType:
        return _SCHEMAS[self.mode]

    def client(self) -> Client:
        return client(self.node)

    def parts(self, first: int, last: int, criteria: str | None = None) -> list[Range]:
        return [Range(n, min(n + self.batch - 1, last), criteria or self.criteria or "[]") for n in range(first, last + 1, self.batch)]


def _row(x, kind):
    """Nested tuples in the order of a schema; unknown fields are left out, missing ones null."""
    if x is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_row(x.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return [_row(v, kind.elementType) for v in x]
    return x


def _read(o: Options, part: Range) -> Iterator[tuple]:
    own = o.client()
    if o.mode in ("blocks", "compressed"):
        for n in range(part.first, part.last + 1):
            yield _row(retry(lambda n=n: own.block(n, o.mode == "blocks"), passes=(), attempts=o.retries), o.schema)
    else:
        for page in pages(own, o.mode[:-1], part.first, part.last, o.page, json.loads(part.criteria), o.retries):
            for x in page:
                yield _row(x, o.schema)


class ChainReader(DataSourceReader):
    def __init__(self, options: Options):
        self.options, self.first, self.last = options, options.first, options.last
        self.pushed: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]):
        """Take what narrows the range or what a node can filter by; Spark still checks everything it is given back."""
        mode = self.options.mode
        column = ("number",) if mode in ("blocks", "compressed") else ("meta", "blockNumber")
        for f in filters:
            if getattr(f, "attribute", None) == column and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    low = f.value - isinstance(f, LessThan)
                    self.last = low if self.last is None else min(self.last, low)
            elif isinstance(f, EqualTo) and mode in ("events", "transfers") and f.attribute in (("address",), ("sender",), ("recipient",)) and self.options.criteria is None:
                self.pushed[f.attribute[0]] = f.value
            yield f

    def partitions(self) -> list[Range]:
        o, last = self.options, self.last
        if last is None:
            last = int(retry(lambda: o.client().block(o.until, False), passes=(), attempts=o.retries)["number"])
        return o.parts(self.first, last, json.dumps([self.pushed]) if self.pushed else None)

    def read(self, partition: Range) -> Iterator[tuple]:
        return _read(self.options, partition)


class ChainStream(DataSourceStreamReader):
    def __init__(self, options: Options, now=time.time):
        self.options, self.now = options, now
        self.at, self.pause, self.stamp = options.first, 0.0, None

    def initialOffset(self) -> dict:
        return {"block": self.options.first}

    def latestOffset(self) -> dict:
        """One past the newest block that may be read, as many blocks on as the window allows: one at the tip, up to ``maxBlocksPerTrigger`` behind it."""
        if self.now() < self.pause:
            return {"block": self.at}
        try:
            newest = self.options.client().block(self.options.until, False)
        except (BlockNotFound, RateLimited, OSError) as e:
            self.pause = self.now() + (POLL if isinstance(e, BlockNotFound) else LIMITED if isinstance(e, RateLimited) else ERROR)
            log.warning("no newest block: %s", e)
            return {"block": self.at}
        last = int(newest["number"]) + 1
        if self.options.most:
            last = min(last, self.at + prefetch_size(self.stamp, int(self.now()), self.options.most))
        self.at = max(self.at, last)
        self.stamp = int(newest["timestamp"]) if self.at > int(newest["number"]) else None
        return {"block": self.at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = max(self.at, end["block"])
        return self.options.parts(start["block"], end["block"] - 1)

    def read(self, partition: Range) -> Iterator[tuple]:
        return _read(self.options, partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept at the node."""


class ChainSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chain"

    def schema(self) -> T.StructType:
        return Options.of(self.options).schema

    def reader(self, schema: T.StructType) -> ChainReader:
        return ChainReader(Options.of(self.options))

    def streamReader(self, schema: T.StructType) -> ChainStream:
        return ChainStream(Options.of(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Make the format known. Spark passes filters to Python sources only where this setting says so."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChainSource)
    return spark
