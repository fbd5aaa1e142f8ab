"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are cut before a space that follows a word character: no match of the
splitting pattern goes over such a place and no look-ahead sees past it, so the
parts encode to the same ids as the whole. A run of very many white-space characters
is one match, without its last character if something follows, and goes to the
library as one piece: its pattern matcher has no room for such a run. Decoding joins
the raw bytes of ids; they need not be valid text.

Cases: null counts as empty; an empty text has no ids and decodes to no bytes.
Strings that look like special tokens are ordinary text. Repeated rows stay, and
the columns in ``carry`` are handed through untouched. An empty table gives an
empty one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import pieces

#: Characters of a text that are encoded at once, up to the next safe boundary.
SPLIT = 1 << 16
_SAFE = re.compile(r"\w ")
#: White space, as the library's pattern has it, that is more than the matcher gets.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RUN = re.compile(_SPACE + "{4096,}")


@lru_cache(2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file: a line has a token's bytes in base64 and its rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def tokens(path: str, pattern: str) -> list[bytes]:
    """Raw bytes of each id."""
    e = encoding(path, pattern)
    return [e.decode_single_token_bytes(i) for i in range(e.n_vocab)]


def parts(text: str, size: int = SPLIT) -> Iterator[str]:
    """The text in parts that encode independently."""
    at = 0
    while len(text) - at > size and (m := _SAFE.search(text, at + size)):
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:]


def encode_text(e: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= SPLIT:
        return e.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for run in _RUN.finditer(text):
        # the last white-space character may belong to what follows
        end = run.end() - (run.end() < len(text))
        for part in parts(text[at : run.start()]):
            ids += e.encode_ordinary(part)
        ids += e._encode_single_piece(text[run.start() : end])
        at = end
    for part in parts(text[at:]):
        ids += e.encode_ordinary(part)
    return ids


def _codec(path: str, pattern: str, carry: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, table = encoding(path, pattern), tokens(path, pattern)
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = [encode_text(e, x) for x in pc.fill_null(part.column("text"), "").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.fromiter((i for x in ids for i in x), np.int32, offsets[-1])
                raw = [b"".join([table[i] for i in x]) for x in ids]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.ListArray.from_arrays(offsets, flat), pa.array(raw, pa.binary())], [*carry, "ids", "decoded"])

    return run


def round_trip(docs: DataFrame, path: str, pattern: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, ids (array of int) and decoded (the ids' raw bytes) of each row's text."""
    if taken := {"ids", "decoded"} & set(carry):
        raise ValueError(f"these columns are given anyway: {', '.join(sorted(taken))}")
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*dict.fromkeys((*carry, "text"))).mapInArrow(_codec(path, pattern, carry), f"{kinds}, ids array<int>, decoded binary")


def digest(coded: DataFrame) -> DataFrame:
    """n_tokens and the two SHA-256 columns in place of ids and decoded."""
    rest = [c for c in coded.columns if c not in ("ids", "decoded")]
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(*rest, F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
