"""Benchmark decontamination with DataFrame operations alone.

Method: the distinct windows of 13 normalised words of the test items are hashed into one
broadcast hash relation (its size is checked; beyond the bound the same join is shuffled, each
window under several keys, so that a passage in very many documents is dealt over tasks).
Every document is split into words once. Flags of the windows' first two words and of whole
windows, broadcast too, say at each word position whether a window can begin there; only such
windows are looked up in the hash relation and verified word by word. The union of a
document's hit windows gives its hit words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.llm.common import ascii_lower, fits, fresh, materialise, small_enough

WINDOW = 13
#: Flags for each window, and how many at most; more windows than they can tell apart are looked up more often, nothing else.
FLAGS, MOST_FLAGS = 64, 1 << 23
#: Keys that the occurrences of one window are dealt over where the windows are too many for a broadcast.
SPLIT = 16
_PART = 1024
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPANS = "array<struct<at:int,end:int>>"


def words(text: Column) -> Column:
    """Normalised words; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BETWEEN), "")


def windows(benchmark: DataFrame) -> DataFrame:
    """_key, _item, _n, _words: the distinct windows of each item; an item of fewer words than a window is one."""
    items = benchmark.select(F.col("item_id").alias("_item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0))), lambda i: F.slice("w", i + 1, WINDOW)
    )
    return (
        items.select("_item", F.explode(cut).alias("_words"))
        .distinct()
        .select(F.xxhash64("_words").alias("_key"), "_item", F.size("_words").alias("_n"), "_words")
    )


def _told(flags: Column, key: Column, size: int) -> Column:
    return F.get(flags, F.pmod(key, F.lit(size)).cast("int"))


def _flags(found: DataFrame, size: int) -> Column:
    """size booleans, true where the key of a window or of its first two words falls: the hash set in a form that is
    looked up inside array functions. Its size is set beforehand, whatever it holds."""
    keys = F.explode(F.array("_key", F.xxhash64(F.get("_words", F.lit(0)), F.get("_words", F.lit(1)))))
    place = found.select(keys.alias("k")).select(F.pmod("k", F.lit(size)).alias("p"))
    parts = place.groupBy(F.expr(f"p div {_PART}").alias("id")).agg(F.collect_set(F.expr(f"int(p % {_PART})")).alias("at"))
    parts = found.sparkSession.range(size // _PART).join(parts, "id", "left").select(
        "id", F.coalesce(F.transform(F.sequence(F.lit(0), F.lit(_PART - 1)), lambda i: F.array_contains("at", i)), F.array_repeat(F.lit(False), _PART)).alias("told")
    )
    return parts.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "told"))), lambda r: r["told"]))).scalar()


def _windows_at(w: Column, flags: Column, size: int, n: int) -> Column:
    """at, n, words of the windows of n words that the flags let pass."""
    if n == 1:
        heads = F.transform(w, lambda a: _told(flags, F.xxhash64(a), size))
    else:
        heads = F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: _told(flags, F.xxhash64(a, b), size))
    starts = F.filter(F.transform(heads, lambda told, i: F.when(told, i)), lambda i: i.isNotNull() & (i <= F.size(w) - n))
    window = lambda i: F.slice(w, i + 1, n)
    full = F.filter(starts, lambda i: _told(flags, F.xxhash64(window(i)), size))
    return F.transform(full, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), window(i).alias("words")))


def _scan(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """_doc, _text (hash of the text), _words (number), and for each verified occurrence _at (word position), _n (words)
    and _item; besides one row with _n 0 for each row of documents, hit or not."""
    found = materialise(windows(benchmark))
    lengths = {r["_n"]: r["n"] for r in found.groupBy("_n").agg(F.count("*").alias("n")).collect()}  # at most WINDOW rows
    size = _PART
    while size < min(FLAGS * sum(lengths.values()), MOST_FLAGS):
        size *= 2
    source = documents.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"), words(F.col("text")).alias("_w"))
    docs = source.withColumn("_flags", _flags(found, size))
    kind = "array<struct<at:int,n:int,words:array<string>>>"
    every = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("words"))).cast(kind)
    tried = [_windows_at(F.col("_w"), F.col("_flags"), size, n).cast(kind) for n in sorted(lengths)]
    each = docs.select("_doc", "_text", F.size("_w").cast("long").alias("_words"), F.explode(F.concat(every, *tried)).alias("k")).select(
        "_doc", "_text", "_words", F.col("k.at").alias("_at"), F.col("k.n").alias("_n"), F.col("k.words").alias("_window"), F.xxhash64("k.words").alias("_h")
    )
    test = found.select("_key", "_item", F.col("_n").alias("_m"), F.col("_words").alias("_x"))
    same = (F.col("_h") == F.col("_key")) & (F.col("_n") == F.col("_m")) & (F.col("_window") == F.col("_x"))
    columns = ["_doc", "_text", "_words", "_at", "_n", "_item"]
    if (small := fits(test)) is not None:
        return each.join(small, same, "left").filter((F.col("_n") == 0) | F.col("_key").isNotNull()).select(columns)
    # shuffled: documents' own rows stay out of the join, and a window's occurrences are dealt over SPLIT keys
    each = materialise(each)
    dealt = each.filter("_n > 0").withColumn("_part", F.pmod(F.xxhash64("_doc", "_text", "_at"), F.lit(SPLIT)))
    spread = test.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
    met = dealt.join(spread, same & (F.col("_part") == F.col("_of")))
    return each.filter("_n = 0").withColumn("_item", F.lit(None).cast(test.schema["_item"].dataType)).select(columns).unionByName(met.select(columns))


def hits(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified occurrences: _doc, _text (hash of the text), _at (word position), _n (words), _item.

    Null and empty texts have none; repeated rows repeat theirs; further columns are left out."""
    return _scan(documents, benchmark).filter("_n > 0").drop("_words")


def marks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """_doc, _text, _words, _rows (rows alike), _spans (of hit windows, sorted), _hit (words in windows), _items (sorted ids as text).

    One row for each doc_id and text; spans and items of one document come together, never of several."""
    grouped = _scan(documents, benchmark).groupBy("_doc", "_text").agg(
        F.max("_words").alias("_words"), F.count_if(F.col("_n") == 0).alias("_rows"),
        F.sort_array(F.collect_set(F.when(F.col("_n") > 0, F.struct(F.col("_at").alias("at"), (F.col("_at") + F.col("_n")).alias("end"))))).alias("_spans"),
        F.sort_array(F.collect_set(F.when(F.col("_n") > 0, F.col("_item").cast("string")))).alias("_items"),
    )
    united = F.aggregate(
        "_spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            (a["sum"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["at"], a["end"]))).alias("sum"),
        ),
        lambda a: a["sum"],
    )
    return grouped.withColumn("_hit", united)


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; repeated rows are all returned, each with
    the hits of its own text; empty tables give no rows or no hits. Further columns are left out.
    """
    found = marks(documents, benchmark).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")))
    return found.select(
        F.col("_doc").alias("doc_id"),
        F.col("_words").alias("n_words"),
        F.col("_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
        contaminated(F.col("_hit"), F.col("_words")).alias("contaminated"),
    )


def remove(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, columns as they were, clashing names and all.

    Documents without words, null texts among them, stay; of repeated rows all stay or all go;
    an empty benchmark removes none, an empty table gives none.
    """
    n, h = (fresh(x, documents.columns) for x in ("_doc", "_text"))
    flagged = marks(documents, benchmark).filter(contaminated(F.col("_hit"), F.col("_words"))).select(F.col("_doc").alias(n), F.col("_text").alias(h))
    same = documents["doc_id"].eqNullSafe(F.col(n)) & (F.xxhash64(documents["text"]) == F.col(h))
    return documents.join(small_enough(materialise(flagged)), same, "left_anti")


def strip(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and text: the normalised words of each document outside hit windows, with single spaces between them.

    For removing spans only. Null and empty texts give an empty text; repeated rows are all
    returned, stripped alike; empty tables give no rows or strip nothing; further columns are
    left out. Words and spans are gone through once each, however many there are.
    """
    longest = F.filter("_spans", lambda s, i: F.coalesce(F.get(F.col("_spans"), i + 1)["at"] != s["at"], F.lit(True)))
    found = marks(documents, benchmark).filter(F.size("_spans") > 0).select("_doc", "_text", longest.alias("_spans"))
    docs = documents.select("doc_id", F.xxhash64("text").alias("_key"), words(F.col("text")).alias("_w"))
    joined = docs.join(small_enough(materialise(found)), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_text")), "left")
    spans = F.coalesce(F.col("_spans"), F.array().cast(_SPANS))
    # the words before each span, from the furthest end of earlier ones on (one a position, so WINDOW are enough), and the last ones
    upto = F.array_max(F.transform(spans, lambda s: s["end"]))
    earlier = lambda i: F.transform(F.slice(spans, F.greatest(F.lit(1), i - WINDOW + 2), F.least(F.lit(WINDOW - 1), i)), lambda s: s["end"])
    before = F.transform(spans, lambda s, i: F.struct(s["at"].alias("at"), F.coalesce(F.array_max(earlier(i)), F.lit(0)).alias("end")))
    kept = F.flatten(F.transform(before, lambda s: F.slice("_w", s["end"] + 1, F.greatest(F.lit(0), s["at"] - s["end"]))))
    rest = F.slice("_w", F.coalesce(upto, F.lit(0)) + 1, F.greatest(F.size("_w"), F.lit(1)))
    return joined.select("doc_id", F.concat_ws(" ", F.concat(kept, rest)).alias("text"))
