"""Quality classifier: gated attention over passages (multiple-instance learning).

A document is a bag of passages of about PASSAGE bytes, cut at white space; only the document
has a label. Each passage becomes a feature vector (shares of byte classes, repeated words,
word length, hashed byte pairs), is encoded by one tanh layer, gets an attention weight from a
gate tanh(V h) * sigmoid(U h), and the weighted sum of encodings gives the document's score.

Fitting takes a sample of at most LABELLED labelled rows, those of lowest hash, and of these as many
as have MOST_PASSAGES passages together; both bounds are parameters. Every passage of a row that is
taken is encoded. Scoring runs over every passage of every text.
The model has a fixed size of some ten thousand numbers and travels in the task's closure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlake.llm.common import drop, materialise

PASSAGE = 400
LABELLED = 6_000
#: Passages that the rows of a fit have together, at most (of 93 float32 numbers, so some 110 MB).
MOST_PASSAGES = 300_000
THRESHOLD = 0.3
FOLDS = 5
PAIRS = 64
_SINGLE = b"#*$%&|<>!?.,:;=\"'()-_/\n"
_CLASSES = 5 + len(_SINGLE)
FEATURES = _CLASSES + 4 + PAIRS


def _table() -> np.ndarray:
    """Byte -> class: space, lower, upper, digit, beyond ASCII, single marks; others have the last number."""
    t = np.full(256, _CLASSES, np.int64)
    t[[32, 9, 11, 12, 13]] = 0
    t[97:123], t[65:91], t[48:58], t[128:] = 1, 2, 3, 4
    for i, b in enumerate(_SINGLE):
        t[b] = 5 + i
    return t


_CLASS = _table()


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages, and the number of passages of each text (one at least)."""
    raws = [(t or "").encode() + b"\n" for t in texts]
    sizes = np.array([len(r) for r in raws])
    data = np.frombuffer(b"".join(raws), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    space = np.flatnonzero((data == 32) | (data == 10))
    starts, counts = [], []
    for b, n in zip(begin, sizes, strict=True):
        cut = b + np.arange(1, (n - 1) // PASSAGE + 1) * PASSAGE
        cut = space[np.searchsorted(space, cut)] + 1  # the text's own end is white space
        cut = np.unique(np.concatenate([[b], cut[cut < b + n]]))
        starts.append(cut)
        counts.append(len(cut))
    start = np.concatenate(starts)
    m, length = len(start), np.diff(np.append(start, len(data)))
    of = np.repeat(np.arange(m), length)
    kinds = np.bincount(of * (_CLASSES + 1) + _CLASS[data], minlength=m * (_CLASSES + 1)).reshape(m, -1)[:, :_CLASSES]
    first = np.zeros(len(data), bool)  # of a text; nothing is told across texts, so a score is its own text's alone
    first[begin] = True
    inside = ~first[1:]
    pair = (data[:-1].astype(np.int64) * 31 + data[1:].astype(np.int64) * 17) % PAIRS
    pairs = np.bincount((of[:-1] * PAIRS + pair)[inside], minlength=m * PAIRS).reshape(m, -1)
    word = np.concatenate([[0], space[:-1] + 1])
    size = space - word
    place = np.arange(len(data)) - np.repeat(word, size + 1)
    value = np.add.reduceat((data.astype(np.int64) + 1) * (place * place * 7919 + place * 104729 + 1), word)
    again = (value[1:] == value[:-1]) & (size[1:] > 0) & ~first[word[1:]]
    words = np.bincount(of[word], weights=size > 0, minlength=m)
    same = np.bincount(of[word[1:]], weights=again, minlength=m)
    share = 1 / length[:, None]
    whole = np.repeat(np.log1p(sizes), counts)
    x = np.column_stack(
        [np.sqrt(kinds * share), same / np.maximum(words, 1), length / np.maximum(words, 1) / 20, np.log1p(length), whole, np.sqrt(pairs * share)]
    )
    return x.astype(np.float32), np.array(counts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def _forward(self, x: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        h = np.tanh(x @ w["W"] + w["b"])
        v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (v * u) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}

    def score(self, texts: list[str]) -> np.ndarray:
        x, counts = features(texts)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        return self._forward((x - self.mean) / self.scale, starts, counts)["p"]


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 30, hidden: int = 32, gate: int = 16, seed: int = 7) -> Model:
    """Adam on the cross entropy of the documents' labels."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = ((x - mean) / scale).astype(np.float32)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {"W": draw(x.shape[1], hidden), "b": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate), "a": draw(gate), "c": draw(hidden), "d": np.zeros(1, np.float32)}
    model = Model(mean, scale, w)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(counts))
        for chosen in np.array_split(order, max(1, len(order) // 64)):
            n = counts[chosen]
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            xb = x[np.repeat(first[chosen] - starts, n) + np.arange(n.sum())]
            f = model._forward(xb, starts, n)
            dz_ = (f["p"] - y[chosen]) / len(chosen)
            g = {"c": f["z"].T @ dz_, "d": dz_.sum(keepdims=True)}
            dz = np.repeat(dz_[:, None] * w["c"], n, axis=0)
            da = (dz * f["h"]).sum(1)
            de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), n))
            gated = f["v"] * f["u"]
            g["a"] = gated.T @ de
            dg = de[:, None] * w["a"]
            dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
            g["V"], g["U"] = f["h"].T @ dv, f["h"].T @ du
            dh = (f["a"][:, None] * dz + dv @ w["V"].T + du @ w["U"].T) * (1 - f["h"] ** 2)
            g["W"], g["b"] = xb.T @ dh, dh.sum(0)
            step += 1
            for k, d in g.items():
                d = d + 1e-4 * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                w[k] -= (0.003 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, most: int = LABELLED, passages: int = MOST_PASSAGES) -> Model | None:
    """A model from labels outside the held-out fold; none if there are no two kinds of labels.

    Labels other than 0 and 1 and null doc_ids are left out, and so are doc_ids whose labels
    contradict each other; repeated labels count once. Null texts are empty ones; of rows of one
    doc_id the least text is taken. Further columns are left out. The sample's order, and so the
    model, follows from the rows alone.
    """
    sample = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_d")).agg(F.min(F.col("quality").cast("int")).alias("_y"), F.max(F.col("quality").cast("int")).alias("_z"))
        .filter("_y = _z").select("_d", "_y").orderBy(F.xxhash64("_d"), "_d").limit(most)
    )
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_d"))  # at most so many rows of two numbers
    texts = texts.groupBy(F.col("_d").alias("d"), F.col("_y").alias("y")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    # a text has at most one passage more than PASSAGE goes into its bytes
    upto = F.sum(F.floor(F.octet_length("text") / PASSAGE) + 1).over(Window.orderBy(F.xxhash64("d"), "d"))
    texts = materialise(texts)  # at most so many rows, which two steps read
    chosen = texts.select("d", upto.alias("_upto")).filter(F.col("_upto") <= passages).select("d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                part = batch.slice(i, 16)
                x, counts = features(part.column(2).to_pylist())
                bags = np.split(x, np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([b.tobytes() for b in bags], pa.binary())], names=["d", "y", "x"]
                )

    found = texts.join(F.broadcast(chosen), "d").select("d", "y", "text").mapInArrow(run, "d bigint, y int, x binary").toArrow().to_pylist()
    drop(texts)
    rows = sorted(found, key=lambda r: r["d"])
    y = np.array([r["y"] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows]
    return fit(np.concatenate(bags), np.array([len(b) for b in bags]), y)


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on).

    Null texts are scored as empty ones; repeated rows alike. Without a model every score is
    0.5. An empty table gives none; further columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = np.full(len(texts), 0.5)
            i = 0
            while model is not None and i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) < 500_000):
                    size += len(texts[j])
                    j += 1
                out[i:j] = model.score(texts[i:j])
                i = j
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = docs.mapInArrow(run, "doc_id bigint, score double")
    return made.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
