"""Token counts by a unigram model over byte pieces.

Method: trie-shared dynamic programming. Distinct pre-tokens are inserted in a trie of bytes.
The best score of all ways to cut a prefix into pieces depends on that prefix alone, so it is
computed once, at the node of the prefix, from the scores of the nodes above; each node also
keeps the number of pieces of its best way, which at a pre-token's end is the count wanted.

The vocabulary is a public rank file. A piece of rank r has the log probability
-log(r + RANK_SHIFT), Zipf's law over ranks; nothing is trained. Of equal scores the way with
fewer pieces is taken, then the one with the longer last piece. Scores are added from left to
right in double precision. A byte without a piece costs UNKNOWN.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from boardlake.llm.bpe import load_ranks
from boardlake.llm.chunks import Encoded, chunked, groups

RANK_SHIFT = 2.0
UNKNOWN = -30.0
#: Nodes of a worker's trie; beyond it the trie starts anew, which costs time only.
MOST_NODES = 400_000


class Trie:
    def __init__(self, ranks: dict[bytes, int]):
        self.scores = {p: -math.log(r + RANK_SHIFT) for p, r in ranks.items()}
        for b in range(256):
            self.scores.setdefault(bytes([b]), UNKNOWN)
        self.longest = max(map(len, self.scores))
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]

    def pieces(self, token: bytes) -> int:
        """Pieces of the best way to cut the token."""
        if len(self.best) > MOST_NODES:
            self.clear()
        child, best, count, score = self.child, self.best, self.count, self.scores.get
        node, path = 0, [0]
        for d, byte in enumerate(token, 1):
            key = node << 8 | byte
            below = child.get(key)
            if below is None:
                below = child[key] = len(best)
                top, n = -math.inf, 0
                for start in range(max(0, d - self.longest), d):
                    s = score(token[start:d])
                    if s is not None:
                        above = path[start]
                        s += best[above]
                        if s > top or s == top and count[above] + 1 < n:
                            top, n = s, count[above] + 1
                best.append(top)
                count.append(n)
            node = below
            path.append(node)
        return count[node]


_OPEN: dict[tuple[str, str], Encoded] = {}


def _counter(path: str, pattern: str) -> Encoded:
    """Chunk -> (pre-tokens, pieces) in this worker."""
    if (path, pattern) not in _OPEN:
        import regex

        trie, find = Trie(load_ranks(path)), regex.compile(pattern).findall

        def encode(chunks: list[str]) -> Iterator[tuple[int, int]]:
            for c in chunks:
                tokens = find(c)
                yield len(tokens), sum(trie.pieces(t.encode()) for t in tokens)

        _OPEN[path, pattern] = Encoded(encode)
    return _OPEN[path, pattern]


def token_counts(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_pretokens, n_tokens.

    Null and empty texts have zeros. Rows stand alone, so repeated rows are counted alike; an
    empty table gives none; further columns are left out.
    """
    docs = documents.select("doc_id", "text")
    names = ("n_bytes", "n_pretokens", "n_tokens")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            made = []
            for a, b in groups(texts):
                store = _counter(ranks_path, pattern)
                chunks, which, ends = chunked(texts[a:b])
                found = np.array(store.values(chunks), np.int64)[which]
                sums = np.add.reduceat(found, np.concatenate([[0], ends[:-1]]))  # a text has one chunk at least
                made += [(len(t.encode()), x, y) for t, (x, y) in zip(texts[a:b], sums.tolist(), strict=True)]
            columns = [pa.array([m[i] for m in made], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    return docs.mapInArrow(run, schema)
