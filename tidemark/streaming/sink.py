"""Sinks: what an indexer hands its results to, and a table that keeps them."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import INDEXED_EVENT

CONTROL = "name string, number bigint, id string, status string, updated_at double"


@dataclass(frozen=True)
class BlockId:
    number: int
    id: str | None = None


@dataclass(frozen=True)
class Result:
    """What one step gives: a run of blocks with their events, from blocks or from logs."""

    first: int
    last: BlockId
    events: DataFrame
    status: str
    blocks: DataFrame | None = None
    _calls: DataFrame | None = field(default=None, repr=False)

    @property
    def latest_block_number(self) -> int:
        return self.last.number

    @property
    def call_results(self) -> DataFrame:
        """Blocks with call results; a result of logs has none."""
        if self.blocks is None:
            raise ValueError("a result of logs has no call results")
        return self._calls if self._calls is not None else self.blocks.limit(0)


class Processor(Protocol):
    def last_synced(self) -> BlockId | None: ...

    def rollback(self, number: int) -> None:
        """Forget everything at or after a block."""

    def process(self, result: Result) -> None: ...

    def advance(self, last: BlockId, status: str) -> None:
        """Remember a position without new events."""


class TableProcessor:
    """Events as Parquet, a folder for each run of blocks, and a control table with the position.

    A run's folder is named after its first block and a version; the newest version
    that is whole counts, so writing a run again or cutting it in a rollback
    never leaves a moment without its events, and a repeated run changes nothing.
    The position is one small folder for each indexer, versioned in the same way;
    older versions go, so reading it does not grow with the chain. A rollback moves the
    position first: if it is broken off, the next one finishes it.
    """

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name

    def _fs(self, at: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, at: str) -> list[str]:
        """Names of the whole folders below a path."""
        fs, p = self._fs(at)
        if not fs.exists(p):
            return []
        done = lambda x: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))
        return [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory() and done(x)]

    def _delete(self, at: str) -> None:
        fs, p = self._fs(at)
        fs.delete(p, True)

    def _versions(self) -> dict[int, list[int]]:
        """The versions of each run, by its first block."""
        out: dict[int, list[int]] = {}
        for name in self._names(f"{self.path}/events"):
            first, version = name.removeprefix("run=").split(".")
            out.setdefault(int(first), []).append(int(version))
        return {k: sorted(v) for k, v in sorted(out.items())}

    def _at(self, first: int, version: int) -> str:
        return f"{self.path}/events/run={first}.{version}"

    def _put(self, rows: DataFrame, first: int) -> None:
        """A new version of a run in place of the others."""
        old = self._versions().get(first, [])
        rows.write.mode("overwrite").parquet(self._at(first, (old[-1] if old else 0) + 1))
        for v in old:
            self._delete(self._at(first, v))

    def events(self) -> DataFrame | None:
        live = [self._at(first, v[-1]) for first, v in self._versions().items()]
        return self.spark.read.schema(INDEXED_EVENT).parquet(*live) if live else None

    def _positions(self) -> list[int]:
        return sorted(int(n.removeprefix("v")) for n in self._names(f"{self.path}/control/{self.name}"))

    def control(self) -> DataFrame | None:
        """The newest row of this indexer."""
        found = self._positions()
        return self.spark.read.schema(CONTROL).parquet(f"{self.path}/control/{self.name}/v{found[-1]}") if found else None

    def last_synced(self) -> BlockId | None:
        table = self.control()
        row = table.first() if table is not None else None
        return BlockId(row.number, row.id) if row and row.number is not None and row.number >= 0 else None

    def advance(self, last: BlockId, status: str) -> None:
        old = self._positions()
        row = [(self.name, last.number, last.id, status, time.time())]
        self.spark.createDataFrame(row, CONTROL).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/control/{self.name}/v{(old[-1] if old else 0) + 1}")
        for v in old:
            self._delete(f"{self.path}/control/{self.name}/v{v}")

    def process(self, result: Result) -> None:
        self._put(result.events, result.first)
        self.advance(result.last, result.status)

    def rollback(self, number: int) -> None:
        before = self.last_synced()
        if before is not None and before.number >= number:
            # the id of the block that is now the last, if it has an event, so that the next one's parent can be checked
            kept = self.events()
            rows = kept.where(F.col("blockNumber") == number - 1).select("blockId").limit(1).collect() if kept is not None else []
            self.advance(BlockId(number - 1, rows[0].blockId if rows else None), "INITIALISED")
        runs = self._versions()
        for first, versions in runs.items():
            if first >= number:
                for v in versions:
                    self._delete(self._at(first, v))
        over = [first for first in runs if first < number]
        if over:
            # only the last run before the block can reach it
            rows = self.spark.read.schema(INDEXED_EVENT).parquet(self._at(over[-1], runs[over[-1]][-1]))
            if rows.where(F.col("blockNumber") >= number).head(1):
                self._put(rows.where(F.col("blockNumber") < number), over[-1])
