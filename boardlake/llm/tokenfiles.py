"""Token-ID files with Elias-Fano boundaries.

Method: the ids of a shard's documents are one array; the ends of the documents in it are an
Elias-Fano sequence: of each end the low bits stand in a packed array and the high bits as a
unary bit vector, about 2 + log2(ids / documents) bits each. Every SELECT-th one bit has its
place noted, so the end of any document is found by a select inside a few bytes, and no 64-bit
offset table is written.

Format. A dataset is a folder of Parquet files of blocks, partitioned by nothing; a block is
(shard, block, n_docs, n_ids, width, ids, the ends' low_bits, low, high and marks, n_null,
first_key, and the keys' low_bits, low, high and marks): ids in width bytes each,
little-endian; keys the documents' doc_ids less the first one, ascending and so an Elias-Fano
sequence too, behind n_null null ones. Blocks hold whole documents and about BLOCK_IDS ids, so
no block and no task grows with the input, and a longer document is a block of its own. Rows are range-partitioned by doc_id: shards ascend, and so do blocks in a shard.
Only one count per block comes together, in running sums by shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boardlake.llm.bpe import packed
from boardlake.llm.chunks import Encoded, groups
from boardlake.llm.common import materialise, small_enough

END_ID = 2
BLOCK_IDS = 262_144
SELECT = 64
_BLOCKS = (
    "shard int, block long, n_docs long, n_ids long, width int, ids binary, low_bits int, low binary, high binary,"
    " marks binary, n_null long, first_key long, key_bits int, key_low binary, key_high binary, key_marks binary"
)
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_OPEN: dict[str, Encoded] = {}


def _ids(path: str) -> Encoded:
    """Chunk -> ids (little-endian unsigned 32-bit) by the library, in this worker."""
    if path not in _OPEN:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def encode(chunks: list[str]) -> Iterator[bytes]:
            for i in range(0, len(chunks), 4096):
                for e in tokenizer.encode_batch_fast(chunks[i : i + 4096], add_special_tokens=False):
                    yield packed(e.ids)

        _OPEN[path] = Encoded(encode, 500_000)
    return _OPEN[path]


class EliasFano:
    """A non-decreasing sequence of whole numbers."""

    def __init__(self, low_bits: int, low: bytes, high: bytes, marks: bytes, n: int):
        self.low_bits, self.n = low_bits, n
        self.low, self.high = low, np.frombuffer(high, np.uint8)
        self.marks = np.frombuffer(marks, "<u4")

    @staticmethod
    def pack(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
        """low_bits, low, high, marks."""
        n = len(values)
        values = values.astype(np.uint64)
        most = int(values[-1]) if n else 0
        bits = max(0, (most // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return (
            bits,
            np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(),
            np.packbits(high, bitorder="little").tobytes(),
            ones[::SELECT].astype("<u4").tobytes(),
        )

    def _low(self, i: int) -> int:
        start = i * self.low_bits
        part = int.from_bytes(self.low[start // 8 : (start + self.low_bits + 7) // 8], "little")
        return part >> start % 8 & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """The i-th value: from the nearest mark on, over few bytes."""
        first = i // SELECT * SELECT
        at, skip = divmod(int(self.marks[i // SELECT]), 8)
        seen, byte = 0, at
        bits = int(self.high[at]) >> skip
        base = at * 8 + skip
        left = i - first
        while True:
            ones = bits.bit_count()
            if seen + ones > left:
                break
            seen += ones
            byte += 1
            bits, base = int(self.high[byte]), byte * 8
        for _ in range(left - seen):
            bits &= bits - 1
        place = base + (bits & -bits).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def every(self) -> np.ndarray:
        """All values, one select each, modulo 2 ** 64."""
        return np.array([self.select(i) & 0xFFFFFFFFFFFFFFFF for i in range(self.n)], np.uint64)


def write(documents: DataFrame, tokenizer_path: str, folder: str) -> None:
    """Write the ids of all texts, END_ID after each, in ascending order of doc_id.

    Null and empty texts have END_ID alone. Rows of one doc_id stand together, in the order of
    their texts; a null doc_id stands first. An empty table gives an empty dataset.
    """
    spark = documents.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(count, "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", "text")
        .withColumn("shard", F.spark_partition_id())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, n, block = [], [], 0, 0
        names, kinds = zip(*(x.split() for x in _BLOCKS.split(", ")), strict=True)

        def flush(shard: int) -> pa.RecordBatch:
            nonlocal keys, parts, n, block
            ids = np.concatenate(parts)
            width = 2 if ids.max(initial=0) < 1 << 16 else 4
            known = np.array([k for k in keys if k is not None], np.int64)
            first = int(known[0]) if len(known) else 0
            with np.errstate(over="ignore"):
                above = known.view(np.uint64) - np.array([first], np.int64).view(np.uint64)
            row = (
                shard, block, len(keys), len(ids), width, ids.astype(f"<u{width}").tobytes(), *EliasFano.pack(np.cumsum([len(p) for p in parts])),
                len(keys) - len(known), first, *EliasFano.pack(above),
            )
            keys, parts, n, block = [], [], 0, block + 1
            return pa.RecordBatch.from_arrays([pa.array([v], _KINDS[k]) for v, k in zip(row, kinds, strict=True)], names=list(names))

        shard = 0
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            shard = batch.column(2)[0].as_py() if len(docs) else shard
            for a, b in groups(texts):
                ids, ends = _ids(tokenizer_path).flat(texts[a:b], "<u4")
                ids = np.insert(ids, ends, END_ID)  # after each document
                for key, made in zip(docs[a:b], np.split(ids, ends[:-1] + np.arange(1, len(ends))), strict=True):
                    if n and n + len(made) > BLOCK_IDS:
                        yield flush(shard)
                    keys.append(key)
                    parts.append(made)
                    n += len(made)
        if keys:
            yield flush(shard)

    ordered.mapInArrow(run, _BLOCKS).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens, ids (binary, unsigned 32-bit) from the files.

    One row for each row that was written, null doc_ids and repeated rows among them; none from
    an empty dataset. Each end and key is selected from its Elias-Fano sequence.
    """
    blocks = spark.read.schema(_BLOCKS).parquet(folder)
    sizes = blocks.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    # one row for each shard; blocks add up inside their shard
    before = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("_before"))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    at = sizes.withColumn("_inside", inside).join(F.broadcast(before), "shard").select(
        "shard", "block", (F.col("_inside") + F.col("_before")).alias("_start")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = EliasFano(row["low_bits"], row["low"], row["high"], row["marks"], row["n_docs"]).every().astype(np.int64)
                above = EliasFano(row["key_bits"], row["key_low"], row["key_high"], row["key_marks"], row["n_docs"] - row["n_null"]).every()
                with np.errstate(over="ignore"):
                    keys = (above + np.array([row["first_key"]], np.int64).view(np.uint64)).view(np.int64).tolist()
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None] * row["n_null"] + keys, pa.int64()),
                        pa.array(starts + row["_start"], pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    columns = [c for c in blocks.columns if c not in ("shard", "block", "n_ids")] + ["_start"]
    # a few numbers for each block; while they are few enough, the ids needn't be shuffled to meet them
    return blocks.join(small_enough(materialise(at)), ["shard", "block"]).select(*columns).mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    )


def digests(read_back: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read() gives, row by row (nulls and repeated rows too)."""
    return read_back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
