"""Order and time operators over blocks: continuity, reorganisation, batches, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds between blocks, and seconds within which the tip counts as reached.
BLOCK_SECONDS = 10
RECENT_SECONDS = 15


def _sorted(blocks: DataFrame, bucket: int) -> tuple[DataFrame, Column]:
    """Blocks with the last row of the bucket before, so a window holds one bucket of block numbers and no more."""
    b = blocks.withColumn("_bucket", F.floor(F.col("number") / bucket))
    last = b.groupBy("_bucket").agg(F.max_by(F.struct("number", "id"), "number").alias("_last"))
    turn = Window.orderBy("_bucket")
    # a row for each bucket
    edge = last.select("_bucket", F.lag("_last").over(turn).alias("_edge"))
    return b.join(edge, "_bucket"), Window.partitionBy("_bucket").orderBy("number")


def previous(blocks: DataFrame, bucket: int = 100_000) -> DataFrame:
    """Blocks (number, id, ...) with the number and id of the block before them in the table."""
    b, w = _sorted(blocks, bucket)
    before = F.coalesce(F.lag(F.struct("number", "id")).over(w), F.col("_edge"))
    return b.withColumn("_p", before).withColumns({"previousNumber": F.col("_p.number"), "previousId": F.col("_p.id")}).drop("_p", "_edge", "_bucket")


def reorganised(blocks: DataFrame, start: int = 0, bucket: int = 100_000) -> DataFrame:
    """Blocks after ``start`` whose parent is not the block before them."""
    p = previous(blocks, bucket)
    return p.where((F.col("number") > start) & F.col("previousId").isNotNull() & (F.col("previousId") != F.col("parentID")))


def gaps(blocks: DataFrame, bucket: int = 100_000) -> DataFrame:
    """Blocks whose number doesn't follow the one before."""
    return previous(blocks, bucket).where(F.col("number") != F.col("previousNumber") + 1)


def batch(number: Column, start: int, size: int) -> Column:
    """Which run of ``size`` blocks from ``start`` on a block is in."""
    return F.floor((number - start) / size).cast("bigint")


def batch_end(current: Column, size: int, to: int) -> Column:
    """Last block of the batch that begins at ``current``."""
    return F.least(current + size - 1, F.lit(to))


def prefetch(last: Column, now: Column | int, most: Column | int) -> Column:
    """Blocks to fetch at once: one for each interval behind and one more, at most ``most``; that if unknown."""
    now, most = (F.lit(x) if isinstance(x, int) else x for x in (now, most))
    behind = F.greatest(F.floor((now - last) / BLOCK_SECONDS), F.lit(0))
    return F.when(last.isNull(), most).otherwise(F.least(most, behind + 1)).cast("bigint")


def prefetch_size(last: int | None, now: int, most: int) -> int:
    """``prefetch`` for one value."""
    return most if last is None else min(most, max((now - last) // BLOCK_SECONDS, 0) + 1)


def status(timestamp: Column, now: Column | int) -> Column:
    now = F.lit(now) if isinstance(now, int) else now
    return F.when(now - timestamp < RECENT_SECONDS, F.lit("FULLY_SYNCED")).otherwise(F.lit("SYNCING"))


def progress(blocks: DataFrame, every: int, now: int) -> DataFrame:
    """Blocks at which progress is logged."""
    if every <= 0:
        raise ValueError("the interval must be over 0")
    return blocks.where((F.col("number") % every == 0) | (status(F.col("timestamp"), now) == "FULLY_SYNCED"))


def pending(blocks: DataFrame, position: int) -> DataFrame:
    """Blocks that aren't processed yet."""
    return blocks.where(F.col("number") >= position)


def rolled_back(rows: DataFrame, number: int, column: str = "blockNumber") -> DataFrame:
    """A table without its rows at or after a block."""
    return rows.where(F.col(column) < number)


def compressed(blocks: DataFrame) -> DataFrame:
    """Blocks with ids in place of transactions."""
    return blocks.withColumn("transactions", F.transform("transactions", lambda t: t["id"]))


def with_inspections(blocks: DataFrame, results: DataFrame, index: list[int]) -> DataFrame:
    """Blocks with call results (blockId, results array) picked by position for one consumer."""
    some = F.transform(F.array(*[F.lit(i) for i in index]).cast("array<int>"), lambda i: F.get("results", i))
    return blocks.join(results, blocks.id == results.blockId, "left").drop("blockId").withColumn("callResults", some).drop("results")
