"""Byte-level BPE encoding and decoding.

Method: a segment tree over byte positions holds in each node the least pair rank below it;
going down to the left where both sides are equal gives the leftmost least pair. A merge
changes three leaves (the pair, its right half and the pair before it), each in logarithmic
time, so a pre-token of n bytes takes O(n log n), however long.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardlake.llm.chunks import Encoded, groups, spread
from boardlake.llm.common import fresh

_NONE = 1 << 40
#: Ids that are decoded at once.
STEP = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = ranks.get(piece[i : i + 2], _NONE)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    rank = ranks.get
    while (least := tree[1]) != _NONE:
        k = 1
        while k < size:
            k *= 2
            if tree[k] != least:
                k += 1
        i = k - size
        j = after[i]
        end = after[i] = after[j]
        tree[size + j] = _NONE
        if end < n:
            before[end] = i
            tree[size + i] = rank(piece[i : after[end]], _NONE)
        else:
            tree[size + i] = _NONE
        p = before[i]
        if p >= 0:
            tree[size + p] = rank(piece[p:end], _NONE)
        else:
            p = i
        # the three leaves' ancestors, level by level; they soon are the same
        x, y, z = size + p >> 1, size + i >> 1, size + j >> 1
        while z:
            a, b = tree[2 * z], tree[2 * z + 1]
            tree[z] = a if a <= b else b
            if y != z:
                a, b = tree[2 * y], tree[2 * y + 1]
                tree[y] = a if a <= b else b
            if x != y:
                a, b = tree[2 * x], tree[2 * x + 1]
                tree[x] = a if a <= b else b
            x, y, z = x >> 1, y >> 1, z >> 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Codec:
    """One worker's encoder and decoder."""

    _open: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        parts = [b""] * (max(self.ranks.values()) + 1)
        for part, rank in self.ranks.items():
            parts[rank] = part
        self.size = np.array([len(x) for x in parts])
        self.parts, self.start = np.frombuffer(b"".join(parts), np.uint8), np.cumsum(self.size) - self.size
        self.find = regex.compile(pattern).findall
        self.pieces = Encoded(lambda pieces: [packed(merge(p.encode(), self.ranks)) for p in pieces])
        self.store = Encoded(self._encode)

    @classmethod
    def get(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._open:
            cls._open[path, pattern] = cls(path, pattern)
        return cls._open[path, pattern]

    def _encode(self, chunks: list[str]) -> list[bytes]:
        found = [self.find(c) for c in chunks]
        pieces = list(set().union(*found))
        get = dict(zip(pieces, self.pieces.values(pieces), strict=True)).__getitem__
        return [b"".join(map(get, x)) for x in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.store.flat(texts, "<u4")
        return [x.tobytes() for x in np.split(ids, ends[:-1])]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each of these stands for, STEP ids at a time."""
        every, out = np.frombuffer(b"".join(ids), "<u4"), []
        for i in range(0, len(every), STEP):
            out.append(spread(self.parts, self.start, self.size, every[i : i + STEP])[0])
        whole, ends = np.concatenate([*out, self.parts[:0]]), np.cumsum(self.size[every])
        upto = np.concatenate([[0], ends])[np.cumsum([len(x) // 4 for x in ids])]
        return [x.tobytes() for x in np.split(whole, upto[:-1])]


def _mapped(df: DataFrame, column: str, new: list[str], work) -> DataFrame:
    """df with binary columns that work makes from the values of one column."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.BinaryType()) for c in new)])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(at).to_pylist()
            for a, b in groups([v or "" for v in values]):
                made = [pa.array(x, pa.binary()) for x in work(values[a:b])]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*batch.schema.names, *new])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of each text (binary, little-endian unsigned 32-bit).

    Null and empty texts give no ids (empty binary). Each row stands alone, so repeated rows
    give repeated results and an empty table gives an empty one. A column named like the new
    one keeps its name; the new one then gets an underscore before it.
    """

    def work(texts: list) -> list[list[bytes]]:
        return [Codec.get(ranks_path, pattern).encode([t or "" for t in texts])]

    return _mapped(df, text, [fresh(ids, df.columns)], work)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes that the ids of each row stand for; null ids give empty bytes."""

    def work(values: list) -> list[list[bytes]]:
        return [Codec.get(ranks_path, pattern).decode([v or b"" for v in values])]

    return _mapped(df, ids, [fresh(decoded, df.columns)], work)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """encode() and decode() in one pass over the rows: columns ids and decoded (or with underscores)."""

    def work(texts: list) -> list[list[bytes]]:
        codec = Codec.get(ranks_path, pattern)
        ids = codec.encode([t or "" for t in texts])
        return [ids, codec.decode(ids)]

    return _mapped(df, text, [fresh("ids", df.columns), fresh("decoded", df.columns)], work)


def digests(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens and the hashes of empty bytes; repeated rows are all
    returned; an empty table gives none; further columns are left out.
    """
    made = round_trip(documents.select("doc_id", "text"), ranks_path, pattern)
    return made.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
