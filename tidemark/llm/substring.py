"""Repeated passages by super-k-mer partitioning.

A window is ``window`` consecutive words. Its minimiser is the least hash of the
runs of ``seed`` words inside it, the leftmost of equal ones. Consecutive windows
with one minimiser form a super-k-mer. Equal windows have equal minimisers, so

1. every super-k-mer is listed as (minimiser, hash of its words, document,
   place) without text, and only minimisers that two documents have go on;
2. super-k-mers of equal words are one content, whose first document is its
   least; in all later documents the whole super-k-mer goes, so copies need no
   more work;
3. the contents' texts are cut from their first documents, each as one packed
   string, and travel to the bucket of their minimiser, where sorting the windows
   by hash gives each its least document. A minimiser of more than ``hot``
   contents isn't one bucket: its windows are dealt out by their own hashes, with
   the least document pre-aggregated;
4. a content's windows that a smaller document has go in its first document.

Windows are compared by a 64-bit hash within one 64-bit minimiser.

Cases: null, empty and short texts have no window and keep all words. Rows of
one ``doc_id`` are judged alone and never remove each other's words. Rows with a
null id keep all words and remove none. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialise, settled
from .wordhash import MULT, Words, grams, long, mix, pieces, windows

#: Parts into which the contents of one minimiser are dealt to look up whether it is hot.
LANES = 64
#: Windows of a super-k-mer at most; longer runs are parted.
LONGEST = 1024


@dataclass(frozen=True)
class Params:
    window: int = 50
    seed: int = 6
    hot: int = 2000


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Leftmost place of the least value of each run of w."""
    n = len(h) - w + 1
    out, at, span = h.copy(), np.arange(len(h)), 1
    while span < w:  # out[i] is the least of h[i:i + span]
        step = min(span, w - span)
        m = len(out) - step
        right = out[step:] < out[:m]
        at = np.where(right, at[step:], at[:m])
        out = np.where(right, out[step:], out[:m])
        span += step
    return at[:n]


def _cut(h: np.ndarray, at: np.ndarray, p: Params) -> tuple[np.ndarray, ...]:
    """Super-k-mers of all rows: row, first window (word place in the row), windows, minimiser, hash of the words."""
    seeds = grams(h, p.seed)
    w = p.window - p.seed + 1
    none, no = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(seeds) < w:
        return none, none, none, no, no
    place = _least(seeds, w)
    sizes = np.diff(at)
    row = np.repeat(np.arange(len(sizes)), np.maximum(sizes - p.window + 1, 0))
    start = np.concatenate([np.arange(a, b - p.window + 1) for a, b in zip(at[:-1], at[1:], strict=True) if b - a >= p.window] or [np.zeros(0, np.int64)]).astype(np.int64)
    if not len(start):
        return none, none, none, no, no
    m = seeds[place[start]]
    # the value counts, not its place: a line said over and over is one run
    first = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (row[1:] != row[:-1])]))
    n = np.diff(np.concatenate([first, [len(start)]]))
    inner = (np.arange(len(start)) - np.repeat(first, n)) % LONGEST
    first = np.flatnonzero(inner == 0)
    n = np.diff(np.concatenate([first, [len(start)]]))
    words = mix(windows(h, p.window)[start] + inner.astype(np.uint64) * MULT[30])
    content = mix(np.add.reduceat(words, first) + n.astype(np.uint64))
    return row[first], start[first] - at[row[first]], n, m[first], content


def _list(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column("text"))
                row, start, n, least, content = _cut(words.hashes(), words.at, p)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([long(least), long(content), part.column("doc_id").take(take), part.column("copy").take(take), pa.array(start, pa.int32()), pa.array(n, pa.int32())], ["least", "content", "doc_id", "copy", "start", "n"])

    return run


def _pack(p: Params):
    """One row for each content, with its words as they stand in the text of its first document."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column("text"))
                spots = part.column("spots")
                sizes = np.diff(np.asarray(spots.offsets))
                row = np.repeat(np.arange(part.num_rows), sizes)
                flat = spots.flatten()
                start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
                at = words.at[row] + start
                low, high = words.starts[at], words.ends[at + n + p.window - 2]
                offsets = np.concatenate([[0], np.cumsum(high - low)])
                data = np.concatenate([words.data[a:b] for a, b in zip(low, high, strict=True)] or [np.zeros(0, np.uint8)])
                packed = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([flat.field("least"), flat.field("content"), part.column("doc_id").take(take), packed, flat.field("hot")], ["least", "content", "low", "packed", "hot"])

    return run


def _hashed(part: pa.RecordBatch, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place within the row, and hash of each window of packed strings."""
    words = Words(part.column("packed"))
    every = windows(words.hashes(), p.window)
    n = words.counts() - p.window + 1
    row = np.repeat(np.arange(part.num_rows), n)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, inner, every[words.at[row] + inner]


def _spans(row: np.ndarray, inner: np.ndarray, rows: int) -> pa.Array:
    """Runs of windows of each row as lists of (start, n)."""
    if not len(row):
        return pa.ListArray.from_arrays(np.zeros(rows + 1, np.int32), pa.StructArray.from_arrays([pa.array([], pa.int32())] * 2, ["start", "n"]))
    edge = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (inner[1:] != inner[:-1] + 1)]))
    n = np.diff(np.concatenate([edge, [len(row)]]))
    spans = pa.StructArray.from_arrays([pa.array(inner[edge], pa.int32()), pa.array(n, pa.int32())], ["start", "n"])
    return pa.ListArray.from_arrays(np.searchsorted(row[edge], np.arange(rows + 1)).astype(np.int32), spans)


def _bucket(p: Params):
    """Rows come sorted by minimiser; the last minimiser of a batch waits for the next one."""

    def judge(part: pa.RecordBatch) -> pa.RecordBatch:
        row, inner, value = _hashed(part, p)
        doc = part.column("low").to_numpy()[row]
        bucket = part.column("least").to_numpy()[row]
        order = np.lexsort((doc, value, bucket))
        b, v, d = bucket[order], value[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (v[1:] != v[:-1])]))
        least = np.repeat(d[first], np.diff(np.concatenate([first, [len(d)]])))
        gone = np.sort(order[d > least])
        return pa.RecordBatch.from_arrays([part.column("least"), part.column("content"), _spans(row[gone], inner[gone], part.num_rows)], ["least", "content", "gone"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("least").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut or (held and held[-1].column("least")[-1].as_py() != key[0]):
                yield from done([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        yield from done(held)

    def done(held):
        held = [x for x in held if x.num_rows]
        if held:
            # buckets stay whole: each has at most p.hot rows
            every = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = every.column("least").to_numpy()
            edges = np.concatenate([np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), [len(key)]])
            at = 0
            while at < len(key):
                e = edges[max(np.searchsorted(edges, at + p.hot, "right") - 1, np.searchsorted(edges, at, "right"))]
                yield judge(every.slice(at, e - at))
                at = int(e)

    return run


def _windows(p: Params):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "packed", 1 << 20):
                row, inner, value = _hashed(part, p)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("least").take(take), part.column("content").take(take), long(value), part.column("low").take(take), pa.array(inner, pa.int32())], ["least", "content", "value", "low", "inner"])

    return run


def repeated_spans(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, copy, spans): runs of windows that also start in a document with a smaller id.

    ``copy`` is xxhash64 of the text; a span has the place of its first word and
    its number of windows. ``docs`` has doc_id, copy and text. The result is a written table.
    """
    return settled(lambda: _repeated(docs, params), "spans")


def _repeated(docs: DataFrame, p: Params) -> DataFrame:
    some = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    listed = materialise(some.mapInArrow(_list(p), "least long, content long, doc_id long, copy long, start int, n int"), "superkmers")
    stats = listed.groupBy("least").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    # written, so that both sides of the join are plain shuffles, whose hot partitions Spark splits
    stats = materialise(stats.select("least"), "minimisers")
    shared = materialise(listed.join(stats, "least"), "shared")
    discard(listed)
    first = shared.groupBy("least", "content").agg(F.min(F.struct("doc_id", "copy", "start", "n")).alias("f"))
    first = materialise(first.select("least", "content", "f.*"), "contents")
    # the number of contents of a minimiser; only large ones travel on
    large = first.groupBy("least").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > p.hot).select(F.col("least").alias("big"))
    # ``large`` has a row for every ``hot`` contents at least, so its copies for all lanes are few, and no minimiser is one join key
    large = large.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long"))))
    lane = F.pmod("content", F.lit(LANES).cast("long"))
    spots = first.join(large, (F.col("least") == F.col("big")) & (lane == F.col("lane")), "left").select("doc_id", "copy", F.struct("least", "content", "start", "n", F.col("big").isNotNull().alias("hot")).alias("s"))
    spots = spots.groupBy("doc_id", "copy").agg(F.collect_list("s").alias("spots"))
    packed = some.join(spots, ["doc_id", "copy"]).select("doc_id", "text", "spots").mapInArrow(_pack(p), "least long, content long, low long, packed binary, hot boolean")
    packed = materialise(packed, "packed")
    gone = "gone array<struct<start: int, n: int>>"
    cold = packed.where("NOT hot").drop("hot").repartition("least").sortWithinPartitions("least")
    cold = cold.mapInArrow(_bucket(p), f"least long, content long, {gone}").where("size(gone) > 0")
    hot = materialise(packed.where("hot").drop("hot").mapInArrow(_windows(p), "least long, content long, value long, low long, inner int"), "windows")
    lowest = materialise(hot.groupBy("least", "value").agg(F.min("low").alias("m"), F.max("low").alias("high")).where("m < high").drop("high"), "lowest")
    hot = hot.join(lowest, ["least", "value"]).where("low > m").groupBy("least", "content").agg(F.collect_set(F.struct(F.col("inner").alias("start"), F.lit(1).alias("n"))).alias("gone"))
    judged = materialise(cold.union(hot.select("least", "content", F.col("gone").cast("array<struct<start: int, n: int>>"))), "judged")
    discard(packed)
    firsts = first.select("least", "content", F.col("doc_id").alias("low"))
    later = shared.join(firsts, ["least", "content"]).where("doc_id > low").select("doc_id", "copy", "start", "n")
    own = shared.select("least", "content", "doc_id", "copy", "start").join(firsts.join(judged, ["least", "content"]), ["least", "content"]).where("doc_id = low")
    own = own.select("doc_id", "copy", F.col("start").alias("at"), F.explode("gone").alias("g")).select("doc_id", "copy", (F.col("at") + F.col("g.start")).alias("start"), F.col("g.n").alias("n"))
    return later.union(own).groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def _strip(p: Params, give: str):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                spans = part.column("spans")
                words = [b"" if x is None else x.encode() for x in part.column("text").to_pylist()]
                total, gone, kept = [], [], []
                for text, own in zip(words, spans, strict=True):
                    w = text.split()
                    n = len(w)
                    if own.is_valid and len(own.values):
                        cover = np.zeros(n + 1, np.int32)
                        start = own.values.field("start").to_numpy()
                        np.add.at(cover, start, 1)
                        np.add.at(cover, start + own.values.field("n").to_numpy() + p.window - 1, -1)
                        stay = np.flatnonzero(np.cumsum(cover[:n]) == 0)
                        w = [w[i] for i in stay]
                    total.append(n)
                    gone.append(n - len(w))
                    left = text if give == "text" and len(w) == n else b" ".join(w)
                    kept.append(hashlib.sha256(left).hexdigest() if give == "digest" else left.decode())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in part.schema.names if c not in ("text", "spans")] + [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [c for c in part.schema.names if c not in ("text", "spans")] + ["n_words", "n_removed", "kept"])

    return run


def strip_repeats(docs: DataFrame, params: Params = Params(), give: str = "words", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the ``carry`` columns, n_words, n_removed and kept: the words left, joined by one space.

    ``give="text"`` leaves texts that lose nothing as they are; ``give="digest"`` gives the SHA-256 of the words left.
    """
    if taken := {"doc_id", "n_words", "n_removed", "kept"} & set(carry):
        raise ValueError(f"these columns are given anyway: {', '.join(sorted(taken))}")
    # under names of their own, so that no carried column clashes with the columns made here
    own = [f"carried{i}" for i in range(len(carry))]
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("copy"), *[F.col(c).alias(o) for c, o in zip(carry, own, strict=True)])
    spans = repeated_spans(text.select("doc_id", "copy", "text"), params)
    joined = text.join(spans, ["doc_id", "copy"], "left").select("doc_id", *own, "text", "spans")
    kinds = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in ("doc_id", *own))
    return joined.mapInArrow(_strip(params, give), f"{kinds}, n_words long, n_removed long, kept string").toDF("doc_id", *carry, "n_words", "n_removed", "kept")
