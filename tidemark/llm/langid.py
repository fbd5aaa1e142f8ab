"""Language identification by a byte convolutional network in numpy.

A text's bytes are cut into windows of ``length`` bytes, the last one padded with
zeros. Each byte has an embedding; filters of several widths run over a window,
their maxima over its places are the features, and a softmax layer gives the
languages. A text's score for a language is the mean over all its windows,
weighted by their bytes.

Training takes at most ``docs`` labelled ids a language, those of the smallest
hashes of doc_id, one text of each, and of that at most ``windows`` windows evenly
spread over all of it: this bounds the model only. Languages are few: the model
has an output for each. Predictions read whole texts and nothing but the text. On the executors the embedding and each
filter tap are multiplied out to a table of 256 rows, so a convolution is a sum of
table rows.

Cases: a null text and one without a letter are ``und`` with score 0, as all are
where no labelled row exists. Repeated rows are predicted alike. Ties go to the
language that sorts first. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sampling
from .wordhash import pieces, raw


#: Windows that are cut at once.
HELD = 8192


@dataclass(frozen=True)
class Params:
    docs: int = 300
    windows: int = 8
    length: int = 128
    embed: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    epochs: int = 5
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    length: int
    widths: tuple[int, ...]
    #: For each tap, 256 rows of the filters of all widths that reach it, widest first.
    tables: tuple[np.ndarray, ...]
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray


def spread(data: np.ndarray, p: Params) -> np.ndarray:
    """At most ``windows`` windows of a text's bytes, evenly spread over all of it."""
    starts = np.arange(0, max(1, len(data)), p.length)
    starts = starts[np.unique(np.linspace(0, len(starts) - 1, min(len(starts), p.windows)).astype(int))]
    x = np.zeros((len(starts), p.length), np.uint8)
    for part, s in zip(x, starts, strict=True):
        part[: len(data[s : s + p.length])] = data[s : s + p.length]
    return x


def fit(texts: list[str], labels: list[str], p: Params) -> Model:
    """Train on windows of labelled texts."""
    return learn([spread(np.frombuffer(t.encode(), np.uint8), p) for t in texts], labels, p)


def learn(windows: list[np.ndarray], labels: list[str], p: Params) -> Model:
    """Train with Adam on the windows of each labelled text."""
    rng = np.random.default_rng(p.seed)
    names = tuple(sorted(set(labels)))
    x, y = np.concatenate(windows), np.repeat([names.index(label) for label in labels], [len(w) for w in windows])
    f = p.filters
    w = {"e": rng.normal(0, 0.5, (256, p.embed)), "d": rng.normal(0, 0.1, (f * len(p.widths), len(names))), "o": np.zeros(len(names))}
    for k in p.widths:
        w[f"c{k}"] = rng.normal(0, 1 / np.sqrt(k * p.embed), (k * p.embed, f))
        w[f"b{k}"] = np.zeros(f)
    w = {k: v.astype(np.float32) for k, v in w.items()}
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for _ in range(p.epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), p.batch):
            some = order[at : at + p.batch]
            g = _gradient(w, x[some], y[some], p)
            step += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] -= (p.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    widest = sorted(p.widths, reverse=True)
    tables = tuple(np.ascontiguousarray(np.concatenate([w["e"] @ w[f"c{k}"][j * p.embed : (j + 1) * p.embed] for k in widest if k > j], axis=1)) for j in range(max(p.widths)))
    rows = {k: i for i, k in enumerate(p.widths)}
    dense = np.concatenate([w["d"][rows[k] * f : (rows[k] + 1) * f] for k in widest])
    return Model(names, p.length, tuple(widest), tables, np.concatenate([w[f"b{k}"] for k in widest]), dense, w["o"])


def _gradient(w: dict, x: np.ndarray, y: np.ndarray, p: Params) -> dict:
    n, f = len(x), p.filters
    e = w["e"][x]
    feats, kept = [], []
    for k in p.widths:
        wide = np.concatenate([e[:, j : p.length - k + 1 + j] for j in range(k)], axis=2)
        conv = wide @ w[f"c{k}"]
        top = conv.argmax(axis=1)
        best = np.take_along_axis(conv, top[:, None], 1)[:, 0] + w[f"b{k}"]
        feats.append(np.maximum(best, 0))
        kept.append((wide, top, best > 0))
    h = np.concatenate(feats, axis=1)
    z = h @ w["d"] + w["o"]
    q = np.exp(z - z.max(axis=1, keepdims=True))
    q /= q.sum(axis=1, keepdims=True)
    q[np.arange(n), y] -= 1
    q /= n
    g = {"d": h.T @ q, "o": q.sum(axis=0), "e": np.zeros_like(w["e"])}
    back = q @ w["d"].T
    row = np.arange(n)[:, None]
    for i, k in enumerate(p.widths):
        wide, top, on = kept[i]
        dh = back[:, i * f : (i + 1) * f] * on
        picked = wide[row, top]  # n, f, k * embed
        g[f"c{k}"] = np.einsum("nf,nfe->ef", dh, picked)
        g[f"b{k}"] = dh.sum(axis=0)
        de = np.einsum("nf,ef->nfe", dh, w[f"c{k}"]).reshape(n, f, k, p.embed)
        for j in range(k):
            np.add.at(g["e"], x[row, top + j], de[:, :, j])
    return g


def places(rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, row and number of bytes of each window of all rows."""
    sizes = np.diff(rows)
    counts = -(-sizes // length)
    row = np.repeat(np.arange(len(sizes)), counts)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = rows[:-1][row] + inner * length
    return start, row, np.minimum(length, rows[1:][row] - start)


def cut(data: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Windows as rows, padded with zeros."""
    at = np.minimum(start[:, None] + np.arange(length), max(len(data) - 1, 0))
    return data[at] * (np.arange(length) < size[:, None]).astype(np.uint8)


def probabilities(model: Model, x: np.ndarray, block: int = 32) -> np.ndarray:
    """Softmax of each window."""
    f = len(model.bias) // len(model.widths)
    h = np.empty((len(x), len(model.bias)), np.float32)
    room = [np.empty((block * model.length, t.shape[1]), np.float32) for t in model.tables]
    for at in range(0, len(x), block):
        part = x[at : at + block]
        n = len(part)
        flat = part.reshape(-1)
        taps = [np.take(t, flat, axis=0, out=r[: len(flat)], mode="clip").reshape(n, model.length, -1) for t, r in zip(model.tables, room, strict=True)]
        for i, k in enumerate(model.widths):
            own, last = slice(i * f, (i + 1) * f), model.length - k + 1
            conv = taps[0][:, :last, own]  # this filter's columns of the first tap are not read again
            for j in range(1, k):
                conv += taps[j][:, j : j + last, own]
            h[at : at + n, own] = conv.max(axis=1)
    z = np.maximum(h + model.bias, 0) @ model.dense + model.out
    q = np.exp(z - z.max(axis=1, keepdims=True))
    return q / q.sum(axis=1, keepdims=True)


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                letters = np.array([x is not None and any(map(str.isalpha, x)) for x in part.column("text").to_pylist()], bool)
                names, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                if model is not None and letters.any():
                    data, rows = raw(part.column("text"))
                    start, row, size = places(rows, model.length)
                    total = np.zeros((part.num_rows, len(model.languages)))
                    for at in range(0, len(start), HELD):  # a very long text is not held as windows at once
                        some = slice(at, at + HELD)
                        np.add.at(total, row[some], probabilities(model, cut(data, start[some], size[some], model.length)) * size[some, None])
                    some = np.flatnonzero(letters)
                    mean = total[some] / total[some].sum(axis=1, keepdims=True)
                    names[some] = np.array(model.languages, object)[mean.argmax(axis=1)]
                    score[some] = mean.max(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def _windows(p: Params):
    """The windows of each text that has a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, rows = raw(part.column("text"))
                some = [i for i, x in enumerate(part.column("text").to_pylist()) if any(map(str.isalpha, x))]
                x = [spread(data[rows[i] : rows[i + 1]], p).tobytes() for i in some]
                yield pa.RecordBatch.from_arrays([*part.select(["doc_id", "lang"]).take(pa.array(some, pa.int64())).columns, pa.array(x, pa.binary())], ["doc_id", "lang", "windows"])

    return run


def train(docs: DataFrame, usable: Column, params: Params = Params()) -> Model | None:
    """A model from rows of ``docs`` (doc_id, text, lang) for which ``usable`` holds; None without any."""
    p = params
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a row for each language; of each, about twice as many ids as are wanted meet to be ordered
    known = F.broadcast(labelled.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("known")))
    h = F.xxhash64("doc_id")
    some = labelled.select("doc_id", "lang").where("doc_id IS NOT NULL").join(known, "lang").where(sampling.low(h, p.docs, F.col("known"))).select("doc_id", "lang").distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id"))
    ids = some.withColumn("turn", first).where(F.col("turn") <= p.docs).select("doc_id", "lang")
    texts = labelled.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    # at most ``windows`` windows of each text
    cut_ = texts.mapInArrow(_windows(p), "doc_id long, lang string, windows binary")
    # a row for each id, however often it is there
    one = cut_.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("windows").alias("h"), "windows"))["windows"].alias("windows"))
    rows = sorted(one.collect(), key=lambda r: (r.doc_id, r.lang, bytes(r.windows)))
    return learn([np.frombuffer(r.windows, np.uint8).reshape(-1, p.length) for r in rows], [r.lang for r in rows], p) if rows else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text)."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return text.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
