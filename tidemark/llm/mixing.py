"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in an order given by a hash of the id. A copy's
virtual finish time is the source's words up to and including it, divided by the
source's target; a second copy of a document comes after all first ones. All
copies are then range-sorted by finish time and cut where their words reach the
total budget.

Running sums are taken in two steps, over slices of the hash order or of the
finish times and then within each slice, so a source with a third of all rows is
not one task's work. The table of sources is one row a source.

Cases: a null text has size 0; documents and sources of size 0 take nothing.
A null source is a source of its own, ordered last. Rows of one id are ordered
by size and text; equal rows are told apart by a row number. An empty table gives
an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

WEIGHTS = (5, 2, 1)
#: Budget of the mix as a share of all words, in hundredths, and the most a source may be repeated.
SHARE, REPEATS = 150, 2
#: Hex digits of the shuffle key that name a slice of a source: 4,096 slices.
SLICE = 3


def words(text: Column) -> Column:
    """Number of words of whole texts; null has none."""
    trimmed = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(items: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """source, source_size and target of each source.

    A target is the smaller of the source's cap and its weight times one level
    for all. The level is the first one, with sources in order of cap / weight,
    that the next source's cap does not undercut: resharing an excess by weight
    until no target is above its cap ends there.
    """
    sums = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.array(*[F.lit(w) for w in weights])[turn % len(weights)].cast("long")
    s = sums.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * REPEATS)
    every = Window.partitionBy(F.lit(0))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"budget": F.sum("source_size").over(every) * SHARE / 100, "weights": F.sum("weight").over(every), "full": F.coalesce(F.sum("cap").over(before), F.lit(0)), "spent": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    s = s.withColumn("level", (F.col("budget") - F.col("full")) / (F.col("weights") - F.col("spent")))
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("spent", "level"))).over(every)["level"]
    # the rows of equal ratio have the level of the first of them, or a lower one that is the same
    return s.withColumn("l", level).select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("l")).alias("target"))


def mix(docs: DataFrame, seed: int = 0, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """A row for each document and copy: uid, doc_id, source, copy_key, size, source_size, target, copy (1, 2), finish, taken.

    ``taken`` says whether the copy is in the mix; in order of finish the taken
    ones are the mixed corpus. ``copy_key`` is xxhash64 of the text.
    """
    items = docs.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "source", words(F.col("text")).alias("size"),
        F.xxhash64("text").alias("copy_key"), F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}"))).alias("key"),
    )
    items = materialise(items, "sizes")
    src = targets(items, weights)
    part = F.substring("key", 1, SLICE)
    slices = items.groupBy("source", part.alias("slice")).agg(F.sum("size").alias("n"))
    done = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("source", "slice", F.coalesce(F.sum("n").over(done), F.lit(0)).alias("before")).alias("p")
    t = src.alias("t")
    rows = items.withColumn("slice", part).alias("i").join(slices, F.col("i.source").eqNullSafe(F.col("p.source")) & (F.col("i.slice") == F.col("p.slice")))
    order = ["key", F.col("doc_id"), "size", "copy_key", "uid"]
    inner = Window.partitionBy("i.source", "i.slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("uid", "doc_id", F.col("i.source").alias("source"), "size", "copy_key", "key", (F.col("before") + F.sum("size").over(inner)).alias("upto")).alias("r")
    rows = rows.join(t, F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "t.source_size", "t.target")
    copies = rows.withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(1, REPEATS + 1)])))
    finish = (F.col("upto") + (F.col("copy") - 1) * F.col("source_size")) / F.col("target")
    copies = copies.withColumn("finish", F.when((F.col("target") > 0) & (F.col("size") > 0), finish)).drop("upto")
    spark = docs.sparkSession
    line = ["finish", "key", "doc_id", "copy", "size", "copy_key", "uid"]
    dealt = copies.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *line).sortWithinPartitions(*line)
    dealt = materialise(dealt.withColumn("range", F.spark_partition_id()), "mix")
    # a row for each range, of which there are as many as partitions
    ranges = dealt.where("finish IS NOT NULL").groupBy("range").agg(F.sum("size").alias("n"))
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # the targets' sum as an exact number of hundredths of words: no source's cap keeps all of them from taking the share
    budget = min(SHARE, 100 * REPEATS) * (items.agg(F.sum("size")).first()[0] or 0)
    within = Window.partitionBy("range").orderBy(*line).rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("before") + F.sum(F.when(F.col("finish").isNotNull(), F.col("size"))).over(within)
    out = dealt.join(F.broadcast(ranges), "range", "left").withColumn("total", total)
    return out.select("uid", "doc_id", "source", "copy_key", "size", "source_size", "target", "copy", "finish", F.coalesce(F.col("finish").isNotNull() & (F.col("total") * 100 <= F.lit(budget)), F.lit(False)).alias("taken"))


def taken(mixed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words taken, for every row of the documents."""
    words_ = F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken")
    return mixed.groupBy("uid", "doc_id", "size", "source_size", "target").agg(words_).drop("uid")
