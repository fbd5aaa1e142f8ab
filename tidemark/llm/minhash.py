"""Near-duplicate documents by circulant MinHash, banding and exact verification.

A document's set holds its distinct runs of ``shingle`` words with A-Z lowered
(all words as one, if it has fewer). Two permutations of the circle of 2**32
positions give the signature: the first, sigma, places each shingle; the second,
pi, is shifted by k places for coordinate k, whose value is the least
``pi(sigma(x) - k)`` over the set. Bands of ``rows`` neighbouring coordinates
are the buckets.

Equal sets are one class, so copies are never paired. In each bucket every
class is paired with the smallest one; pairs are confirmed on full sets and
joined to components. Classes of buckets whose members still are in different
components are open: of their pairs, those that an exact prefix and positional
filter leaves are confirmed too. So each pair of a bucket is connected,
verified, or proven too different, and no bucket emits all its pairs.

Cases: null, empty and blank texts have an empty set, are linked with nothing
and stay. Rows that share a ``doc_id`` and the text are one document. Different
texts of one id are judged each by its own set; of those in one component at most
one text is kept. Texts are told apart by 64-bit hashes. Rows with a null id are
linked with nothing. An empty table gives an empty table. Columns other than the
id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .storage import discard, materialise, settled
from .wordhash import MULT, Words, grams, long, mix, pieces


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    percent: int = 80  # least 100 * intersection / union
    bands: int = 48
    rows: int = 6  # a pair at 0.8 shares no band with probability (1 - 0.8**6)**48 = 5e-7


#: Elements of the circle that are permuted at once.
_RUN = 1 << 15


def _pi(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit positions, in place; t is room of the same size."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(x, shift, out=t)
        np.bitwise_xor(x, t, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, 16, out=t)
    return np.bitwise_xor(x, t, out=x)


def signatures(circle: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Coordinates (sets x n) of the non-empty sets ``circle[at[i]:at[i + 1]]``."""
    out = np.empty((len(at) - 1, n), np.uint32)
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(at, at[i] + _RUN, "right")) - 1)
        x = circle[at[i] : at[j]]
        y, t, cuts = np.empty_like(x), np.empty_like(x), at[i:j] - at[i]
        for k in range(n):
            np.subtract(x, np.uint32(k), out=y)
            out[i:j, k] = np.minimum.reduceat(_pi(y, t), cuts)
        i = j
    return out


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row."""
    words = Words(column)
    h = words.hashes(lower=True)
    g = grams(h, k)
    sets = []
    for a, b in zip(words.at[:-1], words.at[1:], strict=True):
        if b - a >= k:
            sets.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            few = np.uint64(b - a) + (h[a:b] * MULT[20 : 20 + b - a]).sum(dtype=np.uint64, keepdims=True)
            sets.append(mix(few))
        else:
            sets.append(h[:0])
    return sets


def _sign(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(part.column("text"), p.shingle)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                keys = np.zeros((len(sets), p.bands), np.uint64)
                one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                if len(full):
                    at = np.concatenate([[0], np.cumsum(sizes[full])])
                    every = np.concatenate([sets[i] for i in full])
                    sig = signatures((every >> np.uint64(32)).astype(np.uint32), at, p.bands * p.rows).astype(np.uint64)
                    sig = sig.reshape(len(full), p.bands, p.rows)
                    keys[full] = mix((sig * MULT[: p.rows]).sum(axis=2, dtype=np.uint64) + np.arange(p.bands, dtype=np.uint64) * MULT[40])
                    one[full] = np.add.reduceat(mix(every + np.uint64(1)), at[:-1])
                    two[full] = np.bitwise_xor.reduceat(mix(every * MULT[41]), at[:-1])
                bands = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * p.bands, long(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("copy"), long(sizes), long(one), long(two), bands], ["doc_id", "copy", "n_shingles", "h1", "h2", "bands"])

    return run


def _sets(p: Params):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(part.column("text"), p.shingle)
                yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "items"])

    return run


def _confirm(p: Params):
    """Keep pairs whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True):
                a, b = a.as_buffer(), b.as_buffer()
                if 100 * min(a.size, b.size) < p.percent * max(a.size, b.size):
                    good.append(False)
                    continue
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= p.percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """(a, b) of the pairs with enough similarity. Sets travel to the pair, once for each partner."""
    near = pairs.join(sets.withColumnsRenamed({"cid": "b", "items": "sb"}), "b").join(sets.withColumnsRenamed({"cid": "a", "items": "sa"}), "a").select("a", "b", "sa", "sb")
    return near.mapInArrow(_confirm(p), "a long, b long").distinct()


def _spread(batches):
    for batch in batches:
        for part in pieces(batch, "items"):
            items = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("items")]
            sizes = np.array([len(x) for x in items], np.int64)
            cid = np.repeat(part.column("cid").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(cid), long(np.concatenate(items))], ["cid", "item"])


def _open_pairs(open_: DataFrame, p: Params) -> DataFrame:
    """Every pair (a, b) of different labels that can be similar enough, by the prefix and the positional filter.

    Items are ordered by how many open sets hold them, rarest first. Two similar
    sets share one of the first ``n - ceil(n * percent / 100) + 1`` items of
    each, and from the first shared item on each has as many items as they must share.
    """
    n = (F.octet_length("items") / 8).cast("long")
    heads = open_.select("cid", "label", n.alias("n"))
    items = materialise(open_.select("cid", "items").mapInArrow(_spread, "cid long, item long"), "items")
    held = items.groupBy("item").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    mine = Window.partitionBy("cid")
    ranked = items.join(held, "item").withColumns({"r": F.row_number().over(mine.orderBy("c", "item")), "held": F.count(F.lit(1)).over(mine)})
    spot = F.col("n") - F.col("held") + F.col("r")  # items of no other open set come first
    first = F.col("n") - F.ceil(F.col("n") * p.percent / 100) + 1
    front = ranked.join(heads, "cid").select("item", "cid", "label", "n", spot.alias("spot")).where(F.col("spot") <= first)
    front = materialise(front, "front")
    # sizes of similar sets lie in one class or two neighbouring ones, so an item's sets meet only these
    size = F.floor(F.log("n") / math.log(100.1 / p.percent)).cast("int")
    x = front.select("item", F.explode(F.array(size, size + 1)).alias("size"), *[F.col(c).alias(n) for c, n in zip(("cid", "label", "n", "spot"), ("a", "la", "na", "ia"), strict=True)])
    y = front.select("item", size.alias("size"), *[F.col(c).alias(n) for c, n in zip(("cid", "label", "n", "spot"), ("b", "lb", "nb", "ib"), strict=True)])
    can = f"(na < nb OR (na = nb AND a < b)) AND la <> lb AND 100 * na >= {p.percent} * nb AND {100 + p.percent} * (1 + least(na - ia, nb - ib)) >= {p.percent} * (na + nb)"
    return x.join(y, ["item", "size"]).where(can).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    return judged_copies(docs, params).drop("copy")


def judged_copies(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of ``near_duplicates`` with ``copy``, the xxhash64 of the text, as a written table."""
    return settled(lambda: _judged(docs, params), "judged")


def _judged(docs: DataFrame, p: Params) -> DataFrame:
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("copy"))
    signed = materialise(text.mapInArrow(_sign(p), "doc_id long, copy long, n_shingles long, h1 long, h2 long, bands array<long>"), "signatures")
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    one = ["h1", "h2", "n_shingles"]
    classes = known.groupBy(*one).agg(F.min(F.struct("doc_id", "copy")).alias("first"), F.min_by("bands", "doc_id").alias("bands"))
    # a class is named by its first text, as an id may have several
    classes = materialise(classes.withColumn("cid", F.xxhash64("first.doc_id", "first.copy")), "classes")

    # names alone travel with the buckets' keys, so that their minima are hashed together before the shuffle
    rows = classes.select("cid", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("far")).where("hub < far")
    # written, so that both sides of the join are plain shuffles, whose hot partitions Spark splits
    shared = materialise(shared.select("key", "hub"), "shared")
    rows = materialise(rows.join(shared, "key"), "buckets")
    discard(shared)
    # a pair whose sizes already tell that it is no pair needs no sets
    size = lambda c: classes.select(F.col("cid").alias(c), F.col("n_shingles").alias(f"n{c}"))
    pairs = rows.where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    alike = f"100 * least(na, nb) >= {p.percent} * greatest(na, nb)"
    pairs = materialise(pairs.join(size("b"), "b").join(size("a"), "a").where(alike).select("a", "b"), "pairs")
    # texts only of classes that share a bucket with another
    named = rows.select("cid").distinct()
    sets = materialise(text.select(F.xxhash64("doc_id", "copy").alias("cid"), "text").join(named, "cid", "left_semi").dropDuplicates(["cid"]).mapInArrow(_sets(p), "cid long, items binary"), "sets") if rows.head(1) else None
    label = None
    if sets is not None:
        links = materialise(_verified(pairs, sets, p), "links")
        label = materialise(components(links, "a", "b"), "labels")
        # classes in buckets whose members are in more than one component
        now = rows.join(label.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("label"))
        parted = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        now = now.join(parted.select("key"), "key", "left_semi").select("cid", "label").distinct()
        more = _open_pairs(materialise(sets.join(now, "cid"), "open"), p).join(pairs, ["a", "b"], "left_anti")
        more = materialise(_verified(materialise(more, "pairs"), sets, p), "links")
        if more.head(1):
            label = materialise(components(links.union(more), "a", "b"), "labels")
        discard(sets)

    cls = classes.select(*one, "cid", "first")
    if label is not None:
        linked = materialise(label.join(cls.select(F.col("cid").alias("node"), "first"), "node"), "linked")
        least = linked.groupBy("component").agg(F.min("first").alias("least"))
        linked = linked.join(least, "component").select(F.col("node").alias("cid"), "least")
        cls = cls.join(linked, "cid", "left").select(*one, F.coalesce("least", "first").alias("least"))
    else:
        cls = cls.withColumnRenamed("first", "least")
    cls = cls.alias("c")
    out = signed.select("doc_id", "copy", *one).alias("s").join(cls, [F.col(f"s.{x}") == F.col(f"c.{x}") for x in one], "left")
    linkable = F.col("s.doc_id").isNotNull() & (F.col("s.n_shingles") > 0)
    component = F.when(linkable, F.col("least.doc_id")).otherwise(F.col("s.doc_id"))
    kept = ~linkable | ((F.col("least.doc_id") == F.col("s.doc_id")) & (F.col("least.copy") == F.col("s.copy")))
    return out.select("s.doc_id", "s.copy", F.col("s.n_shingles").alias("n_shingles"), component.alias("component_id"), F.coalesce(kept, F.lit(True)).alias("kept"))
