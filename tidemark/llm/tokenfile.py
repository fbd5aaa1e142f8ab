"""Token-id files: frequency-ranked ids in a byte-aligned code with separate control bytes.

Writing takes two passes over the ids. Every text is encoded once, into a table
in the shared folder; the counts of ids over all documents give each id its rank,
the commonest 0. Documents are then dealt by ranges of doc_id and sorted, and
each task writes blocks of whole documents: two bits a token in the control bytes
say how many bytes (1 to 4) the rank has, and the data bytes follow one another.
A file is a Parquet file whose rows are blocks, so it can be in any store, and a
lost task is written again by Spark's own commit protocol.

Reading gets the lengths of four tokens from each control byte by table lookup,
the places of the data bytes by a running sum, and the ids from the ranks by
another lookup.

Cases: a null text counts as empty and has the end id alone. Rows are in order
of doc_id, null first, then of their ids; repeated rows stay. An empty table
gives files without blocks. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import discard, materialise, place
from .wordhash import pieces

#: Ids of a block, unless one document has more.
BLOCK = 1 << 16
#: Bytes of text that are encoded at once: the larger, the fewer repeated pieces.
TEXT = 32 << 20
#: Matches that a worker remembers.
REMEMBER = 500_000

#: Fixed value: the splitting pattern of byte-level pre-tokenizers.
_MATCH = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LENGTHS = np.array([[1 + (c >> 2 * i & 3) for i in range(4)] for c in range(256)], np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    r = ranks.astype("<u4")
    extra = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[: len(r)] = extra
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    first = ends - lengths
    byte = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = byte[first].astype(np.uint32)
    for i in (1, 2, 3):
        more = np.flatnonzero(lengths > i)
        if not len(more):
            break
        out[more] |= byte[first[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


class PieceEncoder:
    """Ids of texts by a ``tokenizers`` file, as bytes of unsigned little-endian ids.

    A byte-level BPE never joins a space with what stands before it, and looks
    past a space only for more white space. So a text is cut before its spaces,
    and the matches of each distinct piece go to the file's BPE model, which
    encodes each match alone. Texts where white space follows a space aren't cut.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.size = self.model.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}
        # how the file's vocabulary writes bytes: printable ones as themselves, the others from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = sorted(set(range(256)) - set(shown))
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.marks: dict[str, bytes] = {c: self.raw([c])[0] for c in ".,"}
        self.table = [np.array([i], self.dtype).tobytes() for i in range(self.size)]
        own = json.loads(self.model.to_str())
        before = own["pre_tokenizer"] or {}
        #: Whether the file splits by the pattern below and does nothing else; others are left to the library whole.
        self.plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not own["normalizer"] and own["model"]["type"] == "BPE"

    def raw(self, texts: list[str]) -> list[bytes]:
        encoded = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in encoded]

    def match(self, x: str) -> bytes:
        """Ids of one match of the splitting pattern."""
        ids = self.known.get(x)
        if ids is None:
            shown = x.encode().decode("latin-1").translate(self.letters)
            ids = b"".join([self.table[t.id] for t in self.model.model.tokenize(shown)])
            if len(self.known) < REMEMBER:
                self.known[x] = ids
        return ids

    def text(self, x: str) -> bytes:
        return b"".join(map(self.match, _MATCH.findall(x)))

    def batch(self, column: pa.Array) -> pa.Array:
        """Ids of each text of a column, as binary."""
        column = pc.fill_null(column, "")
        if not self.plain:
            return pa.array(self.raw(column.to_pylist()), pa.binary())
        split = pc.split_pattern(column, " ")
        at = np.asarray(split.offsets).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at -= at[0]
        known, match, ids, odd = self.known, self.match, [], []
        for i, x in enumerate(coded.dictionary.to_pylist()):
            word = x[:-1] if x[-1:] in self.marks else x
            if word.isalpha():
                word = " " + word
                found = known.get(word) or match(word)
                ids.append(found if len(word) > len(x) else found + self.marks[x[-1]])
            elif x and not x[0].isspace():
                ids.append(self.text(" " + x))
            else:
                ids.append(b"")
                odd.append(i)
        head = at[:-1]
        first = index[head]
        # the first piece of a text has no space before it
        n = len(ids)
        ids.extend(map(self.text, coded.dictionary.take(pa.array(first)).to_pylist()))
        plain = np.ones(n + len(head), bool)
        plain[odd] = False
        index[head] = n + np.arange(len(head))
        taken = pa.array(ids, pa.large_binary()).take(pa.array(index))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :][at]
        out = pa.Array.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(ends.copy()), taken.buffers()[2]])
        whole = np.add.reduceat(~plain[index], head) if len(head) else head
        if whole.any():
            rows = np.flatnonzero(whole)
            again = iter([self.text(column[int(i)].as_py()) for i in rows])
            out = pc.replace_with_mask(out, pa.array(whole > 0), pa.array(list(again), pa.large_binary()))
        return out


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        last = np.array([end], e.dtype).tobytes()
        for batch in batches:
            for part in pieces(batch, "text", TEXT):
                ids = pc.binary_join_element_wise(e.batch(part.column("text")), pa.scalar(last, pa.large_binary()), pa.scalar(b"", pa.large_binary()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids.cast(pa.binary())], ["doc_id", "ids"])

    return run


def _count(dtype: str, size: int):
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                total += np.bincount(np.frombuffer(x.as_buffer(), dtype), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    return run


def _blocks(dtype: str, ranks: np.ndarray):
    def run(batches):
        shard = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        docs: list = []
        size, block, start = 0, 0, 0

        def done():
            control, data = pack(ranks[np.concatenate(held)])
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([start], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(x) for x in held]], pa.list_(pa.int32())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                ["shard", "block", "start", "docs", "sizes", "control", "data"],
            )

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                own = np.frombuffer(ids.as_buffer(), dtype)
                if held and size + len(own) > BLOCK:
                    yield done()
                    start, block, held, docs, size = start + size, block + 1, [], [], 0
                held.append(own)
                docs.append(doc)
                size += len(own)
        if held:
            yield done()

    return run


_SCHEMA = "shard int, block long, start long, docs array<long>, sizes array<int>, control binary, data binary"


def write(docs: DataFrame, tokenizer: str, end: int = 0) -> str:
    """Write the files of ``docs`` (doc_id, text) to the shared folder and return their folder."""
    spark = docs.sparkSession
    e = encoder(tokenizer)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = materialise(text.mapInArrow(_encode(tokenizer, end), "doc_id long, ids binary"), "ids", "zstd")
    # one row for each id of the vocabulary at most
    counts = coded.select("ids").mapInArrow(_count(e.dtype.str, e.size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = [r.id for r in counts.orderBy(F.desc("n"), "id").collect()]
    ranks = np.zeros(e.size, np.uint32)
    ranks[order] = np.arange(len(order))
    at = place(spark, "tokens")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a hash stands for the ids: bounds of ranges are sampled to the driver
    dealt = coded.withColumn("tie", F.xxhash64("ids")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids").drop("tie")
    dealt.mapInArrow(_blocks(e.dtype.str, ranks), _SCHEMA).write.option("compression", "none").parquet(f"{at}/blocks")
    spark.createDataFrame([(i, x) for i, x in enumerate(order)], "rank long, id long").coalesce(1).write.parquet(f"{at}/ranks")
    discard(coded)
    return at


def _read(order: np.ndarray):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                sizes = np.asarray(row["sizes"].values)
                ids = order[unpack(row["control"].as_buffer(), row["data"].as_buffer(), int(sizes.sum()))]
                ends = np.cumsum(sizes, dtype=np.int64)
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [row["docs"].values, pa.array(np.full(n, row["shard"].as_py(), np.int32)), pa.array(row["start"].as_py() + ends - sizes), pa.array([x.astype("<u4").tobytes() for x in np.split(ids, ends[:-1])], pa.binary())],
                    ["doc_id", "shard", "start", "ids"],
                )

    return run


def read(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (unsigned little-endian 32-bit) from the files in ``at``."""
    order = np.array([r.id for r in spark.read.parquet(f"{at}/ranks").orderBy("rank").collect()], np.uint32)
    blocks = spark.read.schema(_SCHEMA).parquet(f"{at}/blocks")
    # a row for each shard, of which there are as many as tasks that wrote
    totals = blocks.select("shard", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = blocks.mapInArrow(_read(order), "doc_id long, shard int, start long, ids binary")
    return rows.join(F.broadcast(totals), "shard").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "ids")


def crc32(ids: DataFrame) -> DataFrame:
    """The rows of ``read`` with n_tokens and ids_crc32 in place of the ids."""
    return ids.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
