"""Ordering of consumers ("indexers"): dependencies, groups, shared calls.

The lists are as long as there are consumers, so these are driver functions. The
relational forms at the end do the same on tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import shared_folder

T = TypeVar("T")


@dataclass(frozen=True)
class Node:
    name: str
    depends_on: str | None = None
    current: int = 0


def topological(nodes: Sequence[Node]) -> list[Node]:
    """Every node after the one it depends on, otherwise in the order given. Cycles and unknown names are errors."""
    by_name = {n.name: n for n in nodes}
    done: dict[str, Node] = {}
    for n in nodes:
        chain: list[Node] = []
        while n.name not in done:
            if n in chain:
                raise ValueError(f"circular dependency at {n.name}")
            chain.append(n)
            if n.depends_on is None:
                break
            if n.depends_on not in by_name:
                raise ValueError(f"{n.name} depends on {n.depends_on}, which isn't there")
            n = by_name[n.depends_on]
        for x in reversed(chain):
            done[x.name] = x
    return list(done.values())


def components(nodes: Sequence[Node]) -> list[list[Node]]:
    """Nodes that dependencies connect, each list in dependency order."""
    root: dict[str, str] = {}
    out: dict[str, list[Node]] = {}
    for n in topological(nodes):
        root[n.name] = root[n.depends_on] if n.depends_on else n.name
        out.setdefault(root[n.name], []).append(n)
    order = {n.name: i for i, n in enumerate(nodes)}
    return sorted(out.values(), key=lambda g: min(order[n.name] for n in g))


def depends_on_any(node: Node, names: set[str], nodes: Sequence[Node]) -> bool:
    """Whether a node needs one of the named, directly or through others."""
    by_name = {n.name: n for n in nodes}
    seen: set[str] = set()
    while node.depends_on and node.depends_on not in seen:
        if node.depends_on in names:
            return True
        seen.add(node.depends_on)
        if node.depends_on not in by_name:
            return False
        node = by_name[node.depends_on]
    return False


def by_gap(nodes: Sequence[Node], threshold: int) -> list[list[Node]]:
    """Nodes in order of position, parted where the next is more than ``threshold`` away."""
    out: list[list[Node]] = []
    for n in sorted(nodes, key=lambda n: n.current):
        if out and n.current - out[-1][-1].current <= threshold:
            out[-1].append(n)
        else:
            out.append([n])
    return out


def proximity(nodes: Sequence[Node], threshold: int) -> list[list[Node]]:
    """Groups that run together: near in position, and whole along dependencies.

    Chains whose members fall into several groups leave them and become groups of
    their own; each of these then joins the group whose first position is nearest
    to its own, if that is within the threshold.
    """
    if not nodes:
        return []
    groups = by_gap(nodes, threshold)
    where = {n.name: i for i, g in enumerate(groups) for n in g}
    chains = components(nodes)
    torn = [c for c in chains if len({where[n.name] for n in c}) > 1]
    names = {n.name for c in torn for n in c}
    whole = [rest for g in groups if (rest := [n for n in g if n.name not in names])]
    for chain in torn:
        first = min(n.current for n in chain)
        near = min(whole, key=lambda g: abs(min(n.current for n in g) - first), default=None)
        if near is not None and abs(min(n.current for n in near) - first) <= threshold:
            near.extend(chain)
        else:
            whole.append(list(chain))
    return [topological(g) for g in whole]


def merge_calls(wanted: Sequence[Sequence[T]]) -> tuple[list[T], list[list[int]]]:
    """The distinct calls of all consumers, in order of first use, and where each finds its own."""
    place: dict[T, int] = {}
    index = [[place.setdefault(c, len(place)) for c in own] for own in wanted]
    return list(place), index


def pick(results: Sequence[T], index: Sequence[int]) -> list[T]:
    return [results[i] for i in index]


# On tables


def proximity_table(nodes: DataFrame, threshold: int) -> DataFrame:
    """(name, current) with the number of its run of near positions: gaps and islands."""
    w = Window.orderBy("current", "name")
    gap = F.coalesce(F.col("current") - F.lag("current").over(w) > threshold, F.lit(False))
    out = nodes.withColumn("_gap", gap.cast("int"))
    return out.withColumn("grp", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_gap")


def group_ranges(grouped: DataFrame) -> DataFrame:
    """First and last position of each group."""
    return grouped.groupBy("grp").agg(F.min("current").alias("first"), F.max("current").alias("last"), F.count(F.lit(1)).alias("n"))


def merge_calls_table(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls (consumer, ordinal, keys) with the index of the distinct call each uses, by first use.

    Distinct calls are range-sorted by first use and numbered within each range; a
    range begins with the number of calls in those before it.
    """
    spark = calls.sparkSession
    first = calls.groupBy(*keys).agg(F.min(F.struct("consumer", "ordinal")).alias("_first"))
    ranged = first.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_first").withColumn("_range", F.spark_partition_id())
    # written, as ranges come from samples and must be the same in both uses
    at = f"{shared_folder(spark)}/tidemark/calls-{uuid.uuid4().hex}"
    ranged.write.parquet(at)
    ranged = spark.read.schema(ranged.schema).parquet(at)
    # a row for each range
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_first"))
    numbered = ranged.join(F.broadcast(sizes), "_range").withColumn("idx", (F.col("_before") + within - 1).cast("bigint")).drop("_range", "_before", "_first")
    return calls.join(numbered, keys)


def depth(nodes: DataFrame) -> DataFrame:
    """(name, dependsOn) with the root each node hangs on and how far from it, by a recursive query."""
    nodes.createOrReplaceTempView("_tidemark_nodes")
    return nodes.sparkSession.sql(
        """
        WITH RECURSIVE r(name, root, depth) AS (
          SELECT name, name, 0 FROM _tidemark_nodes WHERE dependsOn IS NULL
          UNION ALL
          SELECT n.name, r.root, r.depth + 1 FROM _tidemark_nodes n JOIN r ON n.dependsOn = r.name)
        SELECT name, root, depth FROM r"""
    )


