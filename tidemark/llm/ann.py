"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``near`` nearest pivots in order. It is posted, with
its vector, in the inverted files of the first ``post`` of them. A query goes to
the files of its nearest ``probe`` share of the pivots. In a file, vectors are ranked
by the footrule distance of the two orders (a pivot that one of them lacks counts as
place ``near``); the best ``share`` of them is reranked by exact cosine. A vector that a
query meets in several files is ranked in the first of them only. ``share=1,
probe=1`` reranks every row, which is exact search.

The pivot is the shuffle key: a file is one run of sorted rows, vectors before
queries, and is held by one task at a time. A file of more than ``file`` rows is dealt
into several by the hash of the id, so a pivot with a third of all vectors is many
tasks. Every row is in the index. Equal vectors of a file are one entry with all
their ids, so copies of a vector don't take the places of others. Pivots come from
a bounded sample, the vectors of the ``8 * pivots`` smallest hashes of the id, without
near copies; their number grows with the square root of the table, between
``pivots`` and ``most``.

Cases: vectors that are null, zero, or hold null or non-finite components take
no part. Each length that a query has is indexed apart, and a vector is searched
among those of its own length. Rows with a null id take no part. A query's own row is not a candidate: rows of
the same id aren't. Repeated rows (same id and vector) count once, as queries and
as candidates; an id with several vectors is a candidate with each, once for each
score, and its neighbours as a query are the best over all its vectors. Ties go to the smaller id. Fewer candidates than asked for
give as many rows; an empty table gives an empty one. Columns other than the id and the vector are
not read but by the condition that names the queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sampling
from .storage import materialise


@dataclass(frozen=True)
class Params:
    pivots: int = 128  # at least
    most: int = 1024  # pivots at most
    near: int = 64
    post: int = 2
    probe: float = 0.5
    share: float = 0.2
    least: int = 64  # candidates of a file at least
    file: int = 2048


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def orders(x: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The n nearest pivots of each vector, nearest first; ties to the smaller pivot."""
    return np.argsort(-(_unit(x) @ pivots.T), axis=1, kind="stable")[:, :n].astype(np.int16)


def _apart(sample: np.ndarray, n: int, cosine: float = 0.8) -> np.ndarray:
    """The first n vectors that are no near copies of one before, and others only if there are too few."""
    first: list[int] = []
    rest: list[int] = []
    for i, v in enumerate(sample):
        (rest if len(first) and (sample[first] @ v).max() >= cosine else first).append(i)
    return sample[(first + rest)[:n]]


def _order(pivots: np.ndarray, p: Params, dim: int, far: int):
    """Each vector with its order of pivots: ``near`` of them, for a query ``far`` if that is more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                asked = part.column("asked").to_numpy(zero_copy_only=False)
                order = orders(_matrix(part.column("embedding"), dim), pivots, max(p.near, far))
                cells = [row.tobytes() if q else row[: p.near].tobytes() for row, q in zip(order, asked, strict=True)]
                posts = pa.array([row[: p.post].tolist() for row in order], pa.list_(pa.int32()))
                probes = pa.array([row[:far].tolist() if q else [] for row, q in zip(order, asked, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), pa.array(cells, pa.binary()), posts, probes], ["vec_id", "embedding", "order", "posts", "probes"])

    return run


class File:
    """One pivot's inverted file, or a part of it."""

    def __init__(self, pivot: int, pivots: int, ids: np.ndarray, x: np.ndarray, order: np.ndarray, p: Params):
        whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).reshape(-1)
        _, one, entry = np.unique(whole, return_index=True, return_inverse=True)
        by_entry = np.lexsort((ids, entry))
        # repeated rows are one
        by_entry = by_entry[np.r_[True, (np.diff(entry[by_entry]) != 0) | (np.diff(ids[by_entry]) != 0)]]
        self.ids, self.x, self.order = ids[by_entry], x[one], order[one]
        self.entry = np.searchsorted(entry[by_entry], np.arange(len(one) + 1))
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.several = len(np.unique(self.ids)) < len(self.ids)  # an id has more than one vector here
        self.pivot, self.pivots, self.p = pivot, pivots, p
        self.scored = 0

    def candidates(self, order: np.ndarray) -> np.ndarray:
        """The entries that a query's order of pivots ranks best."""
        p, near = self.p, self.order.shape[1]
        turn = np.full(self.pivots, self.pivots, np.int16)
        turn[order] = np.arange(len(order))
        probed = probes(p, self.pivots)
        # entries whose first file, in the query's order, is this one
        when = np.full(self.pivots, self.pivots, np.int16)
        when[order[:probed]] = np.arange(probed)
        some = np.flatnonzero(when[self.order[:, : p.post]].min(axis=1) == when[self.pivot])
        take = max(p.least, math.ceil(p.share * len(some)))
        if take >= len(some):
            return some
        place = np.minimum(turn, near).astype(np.int16)
        theirs = place[self.order[some]]
        own = np.arange(near, dtype=np.int16)
        # pivots of the entry by their places, and those of the query that the entry lacks
        apart = np.abs(theirs - own).sum(axis=1, dtype=np.int32) - (near - theirs).sum(axis=1, dtype=np.int32)
        return some[np.argpartition(apart, take - 1)[:take]]

    def nearest(self, own: int, v: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k nearest candidates to a query."""
        some = self.candidates(order)
        self.scored += len(some)
        score = (self.x[some] * v).sum(axis=1) / (self.norm[some] * np.sqrt((v * v).sum()))
        # the best entries hold k rows besides the query's own; all entries as good as the last one are looked at
        if len(score) > k + 1 and not self.several:
            least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            some, score = some[score >= least], score[score >= least]
        rows = [self.ids[self.entry[e] : self.entry[e + 1]] for e in some]
        if not self.several:
            rows = [(r[: k + 1] if own not in r[: k + 1] else r[: k + 2]) for r in rows]  # sorted by id
        rows = [r[r != own] for r in rows]
        score = np.repeat(score, [len(r) for r in rows])
        ids = np.concatenate([*rows, np.zeros(0, np.int64)])
        top = np.lexsort((ids, -score))
        if self.several and len(top):
            top = top[np.r_[True, (np.diff(ids[top]) != 0) | (np.diff(score[top]) != 0)]]
        return ids[top[:k]], score[top[:k]]


def probes(p: Params, pivots: int) -> int:
    """Files that a query goes to."""
    return max(1, math.ceil(p.probe * pivots))


def _search(p: Params, pivots: int, dim: int, k: int):
    """Rows come sorted by file, the vectors of a file before its queries."""

    def parts(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return rows.column("vec_id").to_numpy(), _matrix(rows.column("embedding"), dim), np.array([np.frombuffer(o.as_buffer(), np.int16) for o in rows.column("order")])

    def distinct(held: list[tuple]) -> list[tuple]:
        """Repeated rows held once, so a row that is there a million times needs no room for it."""
        ids, x, order = (np.concatenate(c) for c in zip(*held, strict=True))
        one = np.unique(np.rec.fromarrays([ids, np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * dim))).reshape(-1)]), return_index=True)[1]
        return [(ids[one], x[one], order[one])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, file, room = None, [], None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("pivot", "part", "query")], axis=1)
            edges = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = (int(keys[a, 0]), int(keys[a, 1]))
                if own != key:
                    key, held, file, room = own, [], None, 8 * p.file
                rows = parts(batch.slice(a, b - a))
                if not keys[a, 2]:
                    held.append(rows)
                    if sum(len(h[0]) for h in held) > room:
                        held = distinct(held)
                        room = max(room, 2 * len(held[0][0]))
                    continue
                if file is None and held:
                    file, held = File(own[0], pivots, *(np.concatenate(c) for c in zip(*held, strict=True)), p), []
                if file is None:
                    continue
                found = [(np.full(len(i), q), i, s) for q, v, o in zip(*rows, strict=True) for i, s in [file.nearest(q, v, o, k)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    return run


def choose(v: DataFrame, p: Params) -> np.ndarray:
    """The pivots, unit vectors, from one vector each of a bounded sample of ids."""
    known = v.agg(F.approx_count_distinct("vec_id")).first()[0]
    n = int(max(p.pivots, min(p.most, math.sqrt(known) / 2)))
    some = F.broadcast(sampling.ids(v, 8 * n, key="vec_id"))  # at most 8 * n ids
    sample = v.join(some, "vec_id").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy(F.xxhash64("vec_id"), "vec_id").collect()
    return _apart(_unit(np.array(list(dict.fromkeys(tuple(r.embedding) for r in sample)), np.float64)), n)


def _found(v: DataFrame, dim: int, k: int, p: Params) -> DataFrame:
    """query_id, vec_id, score: the best of each file that a query meets, over vectors (vec_id, embedding, asked) of one length."""
    pivots = choose(v, p)
    n, far = len(pivots), probes(p, len(pivots))
    kind = v.schema["embedding"].dataType.simpleString()
    ordered = materialise(v.mapInArrow(_order(pivots, p, dim, far), f"vec_id long, embedding {kind}, order binary, posts array<int>, probes array<int>"), "ordered")
    posted = ordered.select("vec_id", "embedding", "order", F.explode("posts").alias("pivot"))
    # a row for each pivot
    sizes = F.broadcast(posted.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / p.file).cast("long").alias("parts")))
    left = posted.join(sizes, "pivot").select("pivot", F.pmod(F.xxhash64("vec_id"), "parts").alias("part"), F.lit(0).alias("query"), "vec_id", "embedding", F.substring("order", 1, 2 * p.near).alias("order"))
    asked = ordered.select("vec_id", "embedding", "order", F.explode("probes").alias("pivot")).join(sizes, "pivot")
    right = asked.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("query"), "vec_id", "embedding", "order")
    files = left.union(right).repartition("pivot", "part").sortWithinPartitions("pivot", "part", "query", "vec_id")
    return files.mapInArrow(_search(p, n, dim, k), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: Column, k: int = 5, params: Params = Params()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which ``queries`` holds, by cosine."""
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    vector = F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>")
    asked = F.coalesce(queries, F.lit(False)).alias("asked")
    v = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"), asked)
    size = F.size("embedding")
    # a row for each length
    lengths = sorted(r.d for r in v.where("asked").select(size.alias("d")).distinct().collect())
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.union, [_found(v.where(size == d), d, k, params) for d in lengths]).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
