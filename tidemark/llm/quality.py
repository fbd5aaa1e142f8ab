"""A quality classifier by co-training of two views.

The text view has shares of byte values, hashed words, and shape measures of the
whole text; the metadata view has the hashed source, the hashed language and the
length class. Both are logistic regressions. In each round a view labels
documents of an unlabelled pool that it is sure of, on a calibrated scale, and
hands them to the other view. In the end both views are calibrated on labelled
rows kept apart (Platt scaling), their log odds are combined by a third logistic
regression, and all documents are scored.

Fitting uses at most ``labelled`` labelled ids and a pool of at most ``pool``
others, those of the smallest hashes of doc_id: this bounds the model only. Of an
id with several texts one is learned from, and of several labels the largest.

Cases: a null text counts as empty, null metadata is a value of its own. Without
labelled rows of both classes every document scores 1 and stays. Repeated rows
score alike. An empty table gives an empty one. Columns other than doc_id, text,
lang, source and n_chars are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling
from .wordhash import Words, pieces, raw


@dataclass(frozen=True)
class Params:
    labelled: int = 4000
    pool: int = 4000
    rounds: int = 3
    sure: float = 0.97
    handed: int = 200  # of a class in a round
    threshold: float = 0.3  # below one half: a clean document lost costs more than a poor one kept


#: Buckets of hashed words.
_WORDS = 512
_META = (64, 16, 24)


def text_view(column: pa.Array) -> np.ndarray:
    data, rows = raw(column)
    n = len(column)
    x = np.zeros((n, 256 + _WORDS + 6), np.float32)
    words = Words(column)
    h = words.hashes()
    sizes, counts = np.diff(rows), words.counts()
    for i in range(n):
        own = data[rows[i] : rows[i + 1]]
        if not len(own):
            continue
        x[i, :256] = np.sqrt(np.bincount(own, minlength=256) / len(own))
        w = h[words.at[i] : words.at[i + 1]]
        if not len(w):
            continue
        x[i, 256 : 256 + _WORDS] = np.sqrt(np.bincount((w % np.uint64(_WORDS)).astype(np.int64), minlength=_WORDS) / len(w))
        distinct, often = np.unique(w, return_counts=True)
        upper = ((own >= 65) & (own <= 90)).sum()
        x[i, -6:] = len(distinct) / len(w), often.max() / len(w), min(sizes[i] / counts[i], 40) / 10, upper / len(own), np.log1p(len(w)) / 10, (often == 1).sum() / len(w)
    return x


def meta_view(batch: pa.RecordBatch) -> np.ndarray:
    x = np.zeros((batch.num_rows, sum(_META)), np.float32)
    row = np.arange(batch.num_rows)
    for at, size, name in ((0, _META[0], "source"), (_META[0], _META[1], "lang")):
        x[row, [at + (zlib.crc32(v.encode()) % (size - 1) + 1 if v is not None else 0) for v in batch.column(name).to_pylist()]] = 1
    chars = pc.fill_null(pc.cast(batch.column("n_chars"), pa.float64()), 0).to_numpy(zero_copy_only=False)
    x[row, _META[0] + _META[1] + np.minimum(np.log2(np.maximum(chars, 0) + 1), _META[2] - 1).astype(int)] = 1
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 300, rate: float = 0.1) -> np.ndarray:
    """Weights with the intercept last, by Adam on the whole set."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float32)
    y = np.asarray(y, np.float32)
    w = np.zeros(x.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    keep = np.full(len(w), l2, np.float32)
    keep[-1] = 0
    for t in range(1, steps + 1):
        g = x.T @ (_sigmoid(x @ w) - y) / len(y) + keep * w
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w.astype(np.float64)


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass(frozen=True)
class Model:
    text: np.ndarray
    meta: np.ndarray
    #: Slope and shift of each view's log odds, and the weights that combine them.
    scale: tuple[np.ndarray, np.ndarray]
    both: np.ndarray

    def score(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view, and both."""
        a = np.clip(_odds(_odds(t, self.text)[:, None], self.scale[0]), -12, 12)
        b = np.clip(_odds(_odds(m, self.meta)[:, None], self.scale[1]), -12, 12)
        return _sigmoid(a), _sigmoid(b), _sigmoid(_odds(np.stack([a, b], axis=1), self.both))


def fit(t: np.ndarray, m: np.ndarray, y: np.ndarray, pool_t: np.ndarray, pool_m: np.ndarray, p: Params) -> Model | None:
    if len(set(y.tolist())) < 2:
        return None
    # every fifth row is kept apart for calibration
    apart = np.arange(len(y)) % 5 == 4
    if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
        apart = np.zeros(len(y), bool)
    fitted, held = ~apart, apart if apart.any() else ~apart
    given: list[tuple[list[int], list[float]]] = [([], []), ([], [])]
    views, pools = (t, m), (pool_t, pool_m)
    for turn in range(p.rounds + 1):
        w = []
        for own, pool, (rows, labels) in zip(views, pools, given, strict=True):
            w.append(logistic(np.concatenate([own[fitted], pool[rows]]), np.concatenate([y[fitted], labels])))
        scale = tuple(logistic(_odds(own[held], wi)[:, None], y[held], l2=1e-3) for own, wi in zip(views, w, strict=True))
        if turn == p.rounds or not len(pool_t):
            break
        for i in (0, 1):
            sure = _sigmoid(_odds(_odds(pools[i], w[i])[:, None], scale[i]))
            rows, labels = given[1 - i]
            known = set(rows)
            for label, rank in ((1.0, -sure), (0.0, sure)):
                best = [j for j in np.argsort(rank, kind="stable").tolist() if (sure[j] >= p.sure if label else sure[j] <= 1 - p.sure) and j not in known][: p.handed]
                rows += best
                labels += [label] * len(best)
    odds = np.stack([np.clip(_odds(_odds(own[held], wi)[:, None], s), -12, 12) for own, wi, s in zip(views, w, scale, strict=True)], axis=1)
    return Model(w[0], w[1], scale, logistic(odds, y[held], l2=1e-3))


def _score(model: Model | None, p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                if model is None:
                    a = b = both = np.ones(part.num_rows)
                else:
                    a, b, both = model.score(text_view(part.column("text")), meta_view(part))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(a), pa.array(b), pa.array(both), pa.array(both >= p.threshold)], [*part.schema.names, "text_score", "meta_score", "score", "kept"])

    return run


_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def train(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model | None:
    """A model from labels (doc_id, quality) and documents."""
    p = params
    spark = docs.sparkSession
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality")
    # at most ``labelled`` ids, and ``pool`` ones
    known = labels.join(F.broadcast(sampling.ids(labels, p.labelled)), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = sorted((r.doc_id, r.quality) for r in known.collect())
    others = sorted(r.doc_id for r in sampling.ids(docs, p.pool, seed=1).collect())
    pool = spark.createDataFrame([(i,) for i in others], "doc_id long")
    told = {r.doc_id for r in labels.select("doc_id").join(F.broadcast(pool), "doc_id", "left_semi").distinct().collect()}
    use = dict(known)
    rows = [(i, float(q > 0)) for i, q in known] + [(i, None) for i in dict.fromkeys(others) if i not in told and i not in use]
    if not rows:
        return None
    # at most labelled + pool ids
    ids = F.broadcast(spark.createDataFrame(rows, "doc_id long, label double"))
    sample = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).join(ids, "doc_id").mapInArrow(_features, "doc_id long, label double, t binary, m binary")
    # a row for each id, however often it is there
    sample = sample.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("t", "m").alias("h"), "t", "m")).alias("f")).select("doc_id", "label", "f.t", "f.m").collect()
    sample = sorted({(r.doc_id, r.label, bytes(r.t), bytes(r.m)) for r in sample}, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[2], r[3]))
    t = np.array([np.frombuffer(r[2], np.float32) for r in sample]).reshape(len(sample), 256 + _WORDS + 6)
    m = np.array([np.frombuffer(r[3], np.float32) for r in sample]).reshape(len(sample), sum(_META))
    told_ = np.array([r[1] is not None for r in sample], bool)
    y = np.array([r[1] for r in sample if r[1] is not None])
    return fit(t[told_], m[told_], y, t[~told_], m[~told_], p)


def _features(batches):
    for batch in batches:
        for part in pieces(batch, "text"):
            t, m = text_view(part.column("text")), meta_view(part)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([x.tobytes() for x in t], pa.binary()), pa.array([x.tobytes() for x in m], pa.binary())], ["doc_id", "label", "t", "m"])


def score(docs: DataFrame, model: Model | None, params: Params = Params()) -> DataFrame:
    """doc_id, text, lang, source, n_chars, text_score, meta_score, score and kept of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    return rows.mapInArrow(_score(model, params), f"{_COLUMNS}, text_score double, meta_score double, score double, kept boolean")
