"""Connected components by alternating large-star and small-star steps.

Each step is a pre-aggregated minimum for every node and an equi-join. A hub, a
node with over a thousandth of all rows, is no join key: there are less than a
thousand, which are looked up in each round, and their rows are dealt to ``LANES``
keys. The edges of each round are a table in the shared folder; nothing but two
numbers and the hubs' names reaches the driver in a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialise


#: Hubs at most, and the rows that a hub has at least.
HUBS, HUB = 1000, 100
#: Join keys of a hub.
LANES = 64


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _hubs(both: DataFrame, n: int) -> list:
    """The nodes with most rows, at most ``HUBS``."""
    if n <= HUB:
        return []
    return [r.u for r in both.groupBy("u").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > max(HUB, n // HUBS)).select("u").collect()]


def _beside(rows: DataFrame, hubs: list, own: bool) -> DataFrame:
    """Rows (u, v) with m, the least v of their u; with ``own``, u itself if that is less."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"))
    if own:
        least = least.withColumn("m", F.least("u", "m"))
    if not hubs:
        return rows.join(least, "u")
    hub = F.col("u").isin(hubs)
    rows = rows.withColumn("lane", F.when(hub, F.pmod(F.xxhash64("v"), F.lit(LANES))).otherwise(0).cast("int"))
    lanes = F.when(hub, F.sequence(F.lit(0), F.lit(LANES - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(least.select("u", "m", F.explode(lanes).alias("lane")), ["u", "lane"]).select("u", "v", "m")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has an edge to another one.

    ``component`` is the smallest node reachable. Null ends, loops and repeated
    edges are ignored; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct()
    e = materialise(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the rows of a node in the second step are fewer than in the first, so its hubs are among these
        hubs = _hubs(both, 2 * state[0])
        large = _beside(both, hubs, True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _beside(large, hubs, False).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        after = materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(e)
        e, old, state = after, state, _state(after)
        if state == old:
            break
    # stars now: every node but a root has one edge, to its root
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
