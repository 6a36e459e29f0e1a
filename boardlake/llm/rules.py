"""Quality rules with thresholds that follow the data.

Method: each metric is an integer per mille, so a count per value and (lang, source) is a
mergeable quantile sketch of at most 1001 buckets with an error of one per mille: partial
counts of tasks add up, in any order, to the same sketch. A document fails a metric above the
quantile of its own language and source that the metric's rank names; there is no fixed
cutoff. So at most the share beyond the rank fails in any group, groups of fewer documents
than 1 / (1 - rank) lose none, and what is usual in one source may be odd in another. Metrics
and limits are joined and the documents filtered.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardlake.llm.common import fresh, materialise, small_enough

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Metric -> (numerator, denominator, rank per mille of the highest value that passes).
METRICS = {
    "symbols": ("n_symbols", "word_chars", 950),
    "dup_lines": ("n_dup_lines", "n_lines", 995),
    "repeats": ("n_repeat_words", "n_words", 995),
    "upper": ("n_upper", "word_chars", 995),
}
_UPPER = bytes(range(65, 91))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in an 8-word window found twice or more."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    n = end = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + WINDOW - max(i, end)
            end = i + WINDOW
    return n


def counts(text: str) -> tuple[int, ...]:
    """COUNTS of one text."""
    raw = text.encode()
    words = raw.split()  # bytes split on exactly \\x20 and \\x09-\\x0D
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\v\f\r")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(raw) - len(raw.translate(None, _UPPER)),
        len(lines),
    )


def measure(df: DataFrame, text: str = "text", drop_text: bool = False) -> tuple[DataFrame, str]:
    """df with a struct of COUNTS for each row, and that column's name. Null texts count as empty."""
    at, name = df.columns.index(text), fresh("counts", df.columns)
    kept = [i for i, c in enumerate(df.columns) if not (drop_text and c == text)]
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    schema = T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [counts(t or "") for t in batch.column(at).to_pylist()]
            columns = [pa.array([x[i] for x in made], pa.int64()) for i in range(len(COUNTS))]
            struct = pa.StructArray.from_arrays(columns, names=list(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), struct], names=[*(batch.schema.names[i] for i in kept), name]
            )

    return df.mapInArrow(run, schema), name


def _metric(c: str, metric: str):
    top, below, _ = METRICS[metric]
    return F.least(F.lit(1000), F.expr(f"1000 * {c}.{top} div greatest({c}.{below}, 1)"))


def base_failed(c: str):
    return F.expr(f"{c}.n_words < 20 or 100 * {c}.n_repeat_words > 30 * {c}.n_words")


def limits(measured: DataFrame, c: str) -> DataFrame:
    """_lang, _source and per metric _max_<metric>: the highest value that passes in this language and source.

    Documents that fail the base rules are not counted. Null languages and sources are a group
    of their own. An empty table has no groups.
    """
    ranks = F.create_map(*[F.lit(x) for m, (_, _, rank) in METRICS.items() for x in (m, rank)])
    each = measured.filter(~base_failed(c)).select(
        F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), _metric(c, m).alias("value")) for m in METRICS])
        ).alias("m"),
    )
    sketch = each.groupBy("_lang", "_source", "m.metric", "m.value").agg(F.count("*").alias("n"))
    group = Window.partitionBy("_lang", "_source", "metric")  # at most 1001 values
    marked = sketch.withColumn("upto", F.sum("n").over(group.orderBy("value"))).withColumn("total", F.sum("n").over(group))
    reached = F.when(F.col("upto") * 1000 >= F.col("total") * ranks[F.col("metric")], F.col("value"))
    return marked.groupBy("_lang", "_source").agg(
        *[F.min(F.when(F.col("metric") == m, reached)).alias(f"_max_{m}") for m in METRICS]
    )


def judge(measured: DataFrame, most: DataFrame, c: str, kept: str) -> DataFrame:
    """measured with boolean column kept; the columns of limits() get names that measured doesn't have."""
    name = {x: fresh(x, [*measured.columns, kept]) for x in most.columns}
    most = small_enough(most.select(*[F.col(x).alias(y) for x, y in name.items()]))
    of = lambda x: measured[f"`{x}`"].eqNullSafe(F.col(name[f"_{x}"]))
    joined = measured.join(most, of("lang") & of("source"), "left")
    passed = ~base_failed(c)
    for m in METRICS:
        passed = passed & (_metric(c, m) <= F.coalesce(F.col(name[f"_max_{m}"]), F.lit(1000)))
    return joined.withColumn(kept, passed).select(*[F.col(f"`{x}`") for x in measured.columns], kept)


def quality(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts, base_failed and kept.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged alike
    and all returned; an empty table gives none; further columns are left out.
    """
    measured, c = measure(documents.select("doc_id", "lang", "source", "text"), drop_text=True)
    measured = materialise(measured)
    return judge(measured, materialise(limits(measured, c)), c, "kept").select(
        "doc_id", *[f"{c}.{x}" for x in COUNTS[:5]], base_failed(c).alias("base_failed"), "kept"
    )


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they were, clashing names and all.

    Null and empty texts fail; of repeated rows all stay or all go; an empty table gives none.
    Thresholds come from one pass that keeps counts only; a second pass measures each row
    again beside its text, so no text is shuffled or written.
    """
    few, c = measure(documents.select("lang", "source", "text"), drop_text=True)
    most = materialise(limits(few, c))
    measured, c = measure(documents)
    kept = fresh("kept", measured.columns)
    return judge(measured, most, c, kept).filter(F.col(kept)).select(*documents.columns)
