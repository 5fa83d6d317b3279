"""Byte-level BPE encoding of a whole corpus with a public vocabulary.

A text is split by the vocabulary's pattern; each piece is merged pair by pair, always the pair of the lowest rank, the leftmost of equals.
A segment tree over the piece's byte positions stores the leftmost minimum pair rank; a merge changes the pairs at the merged part
and its left live neighbour and clears that of its right one, three point updates of logarithmic cost, so a piece of n bytes takes O(n log n).
Pieces are encoded once per worker and kept; the memory is bounded and only saves time. Null and empty texts have the empty list.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.batches import pieces

DEFAULT_DIR = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of pieces that a worker keeps encoded.
KEPT = 16_000_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    bits = (n - 1).bit_length() if n > 1 else 1
    size = 1 << bits
    never = 1 << 62
    tree = [never] * (2 * size)
    end = list(range(1, n + 1))  # of the live part that starts here
    left = list(range(-1, n - 1))  # start of the live part before
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << bits | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    mask = size - 1

    def put(i: int, key: int) -> None:
        i += size
        if tree[i] == key:
            return
        tree[i] = key
        while i > 1:
            other = tree[i ^ 1]
            if other < key:
                key = other
            i >>= 1
            if tree[i] == key:
                return
            tree[i] = key

    while (low := tree[1]) != never:
        i = low & mask
        j = end[i]
        k = end[j]
        end[i] = k
        put(j, never)
        if k < n:
            left[k] = i
            r = get(piece[i : end[k]])
            put(i, never if r is None else r << bits | i)
        else:
            put(i, never)
        h = left[i]
        if h >= 0:
            r = get(piece[h:k])
            put(h, never if r is None else r << bits | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, kept: int = KEPT):
        self.ranks, self.split, self.kept, self.size, self.known = ranks, regex.compile(pattern).findall, kept, 0, {}

    def _new(self, piece: str) -> tuple[int, ...]:
        ids = tuple(merge_piece(piece.encode("utf-8", "surrogatepass"), self.ranks))
        if len(piece) <= 200:
            self.size += len(piece) + 100
            if self.size > self.kept:
                self.known.clear()
                self.size = 0
            self.known[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for p in self.split(text):
            ids = known.get(p)
            out += self._new(p) if ids is None else ids
        return out


def _broadcast(spark: SparkSession, vocabulary: str | None, folder: str):
    """The rank file's bytes (under 1 MB, read on the driver) for the executors, which need no copy of the folder."""
    with open(vocabulary or f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_ENCODERS: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id] = Encoder(read_ranks(shared.value))
    return _ENCODERS[shared.id]


class _Shared:
    def __init__(self, b):
        self.b, self.id = b, hashlib.md5(b.value).hexdigest()

    def __getstate__(self):
        return {"b": self.b, "id": self.id}

    @property
    def value(self) -> bytes:
        return self.b.value


def encode(df: DataFrame, key: str, text: str, vocabulary: str | None = None, folder: str = DEFAULT_DIR) -> DataFrame:
    """key, ids: the token ids of each row's text, without special tokens; their strings in a text are ordinary text.

    A null and an empty text have the empty list. One row out per row in; other columns are left behind."""
    shared = _Shared(_broadcast(df.sparkSession, vocabulary, folder))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for part in pieces(batches):
            flat, offsets = [], [0]
            for t in part.column(1).to_pylist():
                flat += enc.encode(t)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(flat, "int32")))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str, keep: list[str], vocabulary: str | None = None, folder: str = DEFAULT_DIR, name: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` and the number of tokens of each row's text (0 for a null or an empty one)."""
    shared = _Shared(_broadcast(df.sparkSession, vocabulary, folder))
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for batch in pieces(batches):
            n = pa.array([len(enc.encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), n], names=[*keep, name])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{ddl}, `{name}` long")
