"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes (as estimated by row_bytes) that a broadcast may hold; beyond it the join shuffles instead.
BROADCAST_BYTES = 32 << 20

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where that is unset on one machine (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="boardlake-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what runs in here as soon as each job's result is complete."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors and lets shuffle files go."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    with _dropping_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(*written: DataFrame) -> None:
    """Delete the folders of materialised frames that nothing reads any more."""
    for df in written:
        if path := getattr(df, "_written_to", None):
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def row_bytes(df: DataFrame) -> Column:
    """Estimated bytes of a row in a broadcast relation."""
    width = F.lit(16 + 8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith("array"):
            each = 80 if "struct" in kind else 32 if "string" in kind else 8
            width = width + each * F.greatest(F.coalesce(F.size(F.col(f"`{name}`")), F.lit(0)), F.lit(0))
    return width


def fits(df: DataFrame, most: int | None = None) -> DataFrame | None:
    """df marked for broadcast if its rows have at most so many bytes (BROADCAST_BYTES), else none."""
    total = df.agg(F.sum(row_bytes(df))).first()[0] or 0
    return F.broadcast(df) if total <= (BROADCAST_BYTES if most is None else most) else None


def small_enough(df: DataFrame, most: int | None = None) -> DataFrame:
    """df marked for broadcast if it fits, else df as it is (a shuffled join)."""
    small = fits(df, most)
    return df if small is None else small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """name, or name with underscores before it until no given column has it in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the quick built-in."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(
        F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())
    )


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with _pos: 1, 2, ... inside each group of key by the other columns, nulls first.

    Rows are dealt by ranges of key and order, so a group of any size is spread over tasks. A row's number in its task's
    order is written with it; a group's pieces are then put one after the other by their counts.
    """
    by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    placed = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id()))
    piece = F.shiftright("_row", 33)
    pieces = placed.groupBy(F.col(key).alias("_key"), piece.alias("_piece")).agg(F.min("_row").alias("_first"), F.count("*").alias("_many"))
    before = F.sum("_many").over(Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = pieces.select("_key", "_piece", (F.col("_first") - F.coalesce(before, F.lit(0)) - 1).alias("_from"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (piece == F.col("_piece"))
    return placed.join(starts, same).withColumn("_pos", F.col("_row") - F.col("_from")).drop("_key", "_piece", "_from", "_row")
