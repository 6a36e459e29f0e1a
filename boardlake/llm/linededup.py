"""Line dedup with DataFrame operations alone.

Method: deletion-neighbourhood join. The edit unit is a word and the bound is one edit: two
normalised lines within one substituted, inserted or deleted word share a variant with one
word (or none) left out. All variants of a line are emitted as hashed keys, equal variants
meet in one group that keeps only its earliest member, the edit distance to that member is
verified on the words, and the later line goes. A variant's key is the exclusive or of its
words' hashes with their places, so running totals give all keys of a line in one pass.

Lines of LONG words or more pass a lossless sieve first: of two lines within one edit, the
first HEAD words or the last HEAD words are equal. A line that shares neither with another
line has no neighbour and emits nothing, so the variants stay far below the words of the
corpus. Shorter lines (and those of LONG words, which may meet them) emit theirs as they are.
Exact copies need no variants and meet by two hashes, 128 bits.

Only groups' minima are kept, never pairs: a line that a third of all documents carry is one
row after partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlake.llm.common import drop, fresh, materialise, small_enough

#: The bound: one edit for lines of so many words, none for shorter ones, of which an edit would be a large part.
NEAR_WORDS = 5
#: Words from which on the sieve decides, and how many at either end it compares. An edit leaves one end of HEAD words whole
#: if both lines have LONG words or more, as 2 * HEAD <= LONG.
LONG, HEAD = 12, 6


def norm(line: Column) -> Column:
    """Lower case, without spaces, tabs and carriage returns at the ends; words are what single spaces part."""
    return F.btrim(F.lower(line), F.lit(" \t\r"))


def _count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _lines(documents: DataFrame) -> DataFrame:
    """_doc, _text, _at, _line, _n (words) for each line that isn't empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        documents.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_text"), F.split(text, "\n", -1).alias("_all"))
        .select("_doc", "_text", F.posexplode("_all").alias("_at", "_raw"))  # what a select computes beside it, it computes for each line
        .select("_doc", "_text", "_at", norm(F.col("_raw")).alias("_line"))
        .filter(F.col("_line") != "")
        .withColumn("_n", _count(F.col("_line")))
    )


def _ends(line: Column) -> Column:
    """Keys of the first and the last HEAD words."""
    front, back = (F.call_function("substring_index", line, F.lit(" "), F.lit(n)) for n in (HEAD, -HEAD))
    return F.array(F.xxhash64(F.lit(0), front), F.xxhash64(F.lit(1), back))


def _other(line: str) -> Column:
    """A second hash of a line: lines are equal when both are, and none goes for a collision of one."""
    return F.xxhash64(F.lit(1), line)


def _first(c: str = "_first") -> Column:
    """The earliest place of a group; nulls of doc_id come first, as Spark orders structs."""
    return F.min(F.struct(F.col("_doc").alias("doc"), F.col("_at").alias("at"))).alias(c)


def later_lines(documents: DataFrame, near_from: int = NEAR_WORDS) -> DataFrame:
    """_doc, _text, _gone (sorted array of line positions) of the documents that lose lines."""
    n = F.col("_n")
    table = materialise(
        _lines(documents).select(
            "_doc", "_text", "_at", F.xxhash64("_line").alias("_h"), _other("_line").alias("_k"),
            F.when((n >= LONG) & (n >= near_from), _ends(F.col("_line"))).alias("_ends"),
            F.when((n <= LONG) & (n >= near_from), F.col("_line")).alias("_line"),
        )
    )
    first = materialise(
        table.groupBy("_h", "_k").agg(_first(), F.count("*").alias("_copies"), F.first("_ends").alias("_ends"), F.first("_line").alias("_line"))
    )
    near = _near(documents, first, near_from)
    odd = first.filter(F.col("_copies") > 1).select("_h", "_k", "_first").join(
        near.select(F.col("_h").alias("_g"), F.col("_k").alias("_l"), "_is_near"), (F.col("_h") == F.col("_g")) & (F.col("_k") == F.col("_l")), "full"
    ).select(F.coalesce("_h", "_g").alias("_o"), F.coalesce("_k", "_l").alias("_p"), "_first", F.coalesce("_is_near", F.lit(False)).alias("_is_near"))
    odd = materialise(odd)
    drop(first, near)
    place = F.struct(F.col("_doc").alias("doc"), F.col("_at").alias("at"))
    gone = table.select("_doc", "_text", "_at", "_h", "_k").join(small_enough(odd), (F.col("_h") == F.col("_o")) & (F.col("_k") == F.col("_p"))).filter(
        F.col("_is_near") | (place > F.col("_first"))
    )
    out = materialise(gone.groupBy("_doc", "_text").agg(F.sort_array(F.collect_set("_at")).alias("_gone")))  # of one document
    drop(table, odd)
    return out


def _flags(places: Column) -> Column:
    """An array that is true at the places (sorted, from 0) and false before and between them. It is built from the gaps, so what goes
    along with it takes no longer than the lines of a text."""
    gaps = F.transform(places, lambda at, i: at - F.when(i == 0, F.lit(-1)).otherwise(F.get(places, i - 1)) - 1)
    return F.flatten(F.transform(gaps, lambda n: F.concat(F.array_repeat(F.lit(False), n), F.array(F.lit(True)))))


def _long_lines(documents: DataFrame, first: DataFrame, near_from: int) -> DataFrame:
    """_h, _k, _first, _line, _n of the lines of over LONG words that share an end with another line, each read once, at its earliest place."""
    ends = first.filter(F.col("_ends").isNotNull()).select("_h", F.explode("_ends").alias("_key"))
    shared = ends.groupBy("_key").agg(F.min("_h").alias("a"), F.max("_h").alias("b")).filter(F.col("a") != F.col("b"))
    able = materialise(ends.join(shared.select("_key"), "_key", "left_semi").select("_h").distinct())
    at = materialise(
        first.filter(F.col("_line").isNull()).join(small_enough(able), "_h", "left_semi").groupBy(F.col("_first.doc").alias("_doc"))
        .agg(F.sort_array(F.collect_set("_first.at")).alias("_places"))  # of one document
    )
    docs = documents.select(F.col("doc_id").cast("long").alias("_id"), F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1).alias("_all"))
    numbered = F.transform("_all", lambda line, i: F.struct(i.alias("at"), line.alias("line")))
    wanted = F.array_compact(F.zip_with(numbered, _flags(F.col("_places")), lambda x, told: F.when(told, x)))
    read = docs.join(small_enough(at), F.col("_id").eqNullSafe(F.col("_doc"))).select("_doc", F.explode(wanted).alias("_x"))
    line = read.filter("_x.line is not null").select("_doc", F.col("_x.at").alias("_at"), norm(F.col("_x.line")).alias("_line"))
    out = materialise(
        line.withColumn("_h", F.xxhash64("_line")).withColumn("_k", _other("_line")).withColumn("_n", _count(F.col("_line"))).filter((F.col("_n") > LONG) & (F.col("_n") >= near_from))
        .groupBy("_h", "_k").agg(_first(), F.first("_line").alias("_line"), F.first("_n").alias("_n"))
    )
    drop(able, at)
    return out


def _variants(lines: DataFrame) -> DataFrame:
    """_h, _first, _i, _v: the key of each line without word _i, and of the whole line with _i -1."""
    places = lines.select("_h", "_first", F.posexplode(F.concat(F.split("_line", " "), F.array(F.lit(None)))).alias("_i", "_word")).select(
        "_h", "_first", "_i", F.col("_word").isNull().alias("_whole"),
        F.when(F.col("_word").isNull(), 0).otherwise(F.xxhash64("_word", "_i")).alias("_as_is"),
        F.when(F.col("_word").isNull(), 0).otherwise(F.xxhash64("_word", F.col("_i") - 1)).alias("_moved"),
    )
    by = Window.partitionBy("_h")  # the words of one line
    upto = by.orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.bit_xor("_as_is").over(upto).bitwiseXOR(F.col("_as_is")).bitwiseXOR(F.bit_xor("_moved").over(upto)).bitwiseXOR(F.bit_xor("_moved").over(by))
    return places.select("_h", "_first", F.when(F.col("_whole"), -1).otherwise(F.col("_i")).alias("_i"), key.alias("_v"))


def _near(documents: DataFrame, first: DataFrame, near_from: int) -> DataFrame:
    """_h, _k, _is_near (true) of the lines that have an earlier line within one edit."""
    long = _long_lines(documents, first, near_from)
    lines = first.filter(F.col("_line").isNotNull()).select("_h", "_k", "_first", "_line").unionByName(long.select("_h", "_k", "_first", "_line"))
    every = materialise(_variants(lines))
    # variants that one line alone has meet nothing
    met = every.groupBy("_v").agg(F.min("_h").alias("a"), F.max("_h").alias("b")).filter(F.col("a") != F.col("b")).select("_v")
    variants = materialise(every.join(met, "_v", "left_semi"))
    drop(every)
    me = F.struct(F.col("_first").alias("f"), F.col("_h").alias("h"))
    least = variants.groupBy("_v", "_i").agg(F.min(me).alias("_e"))
    # substitution: the same word left out of both
    swapped = variants.filter("_i >= 0").join(least, ["_v", "_i"]).filter(F.col("_e.f") < F.col("_first"))
    # one word more or less: one line is the other's variant
    of_whole = least.filter("_i = -1").select("_v", F.col("_e").alias("_w"))
    of_less = least.filter("_i >= 0").groupBy("_v").agg(F.min("_e").alias("_w"))
    grown = variants.filter("_i >= 0").join(of_whole, "_v").filter(F.col("_w.f") < F.col("_first"))
    shrunk = variants.filter("_i = -1").join(of_less, "_v").filter(F.col("_w.f") < F.col("_first"))
    pairs = (
        swapped.select("_h", F.col("_e.h").alias("_g"))
        .unionByName(grown.select("_h", F.col("_w.h").alias("_g")))
        .unionByName(shrunk.select("_h", F.col("_w.h").alias("_g")))
        .distinct()
    )
    texts = lines.select("_h", "_k", F.split("_line", " ").alias("x"))
    seen = pairs.join(texts, "_h").join(texts.select(F.col("_h").alias("_g"), F.col("x").alias("y")), "_g")
    out = materialise(seen.filter(one_edit(F.col("x"), F.col("y"))).select("_h", "_k").distinct().withColumn("_is_near", F.lit(True)))
    drop(long, variants)
    return out


def one_edit(x: Column, y: Column) -> Column:
    """Whether word arrays are at most one edit apart: past the common words at the front, what
    is left but for one word of the longer (or of both) is equal."""
    short = F.least(F.size(x), F.size(y))
    same = F.zip_with(F.slice(x, F.lit(1), short), F.slice(y, F.lit(1), short), lambda a, b: a == b)
    at = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, short).cast("int")
    rest = lambda c, skip: F.slice(c, at + 1 + skip, F.size(c) + 1)
    return (F.abs(F.size(x) - F.size(y)) <= 1) & F.when(F.size(x) == F.size(y), rest(x, 1) == rest(y, 1)).when(
        F.size(x) > F.size(y), rest(x, 1) == rest(y, 0)
    ).otherwise(rest(x, 0) == rest(y, 1))


def dedup(documents: DataFrame, near_from: int = NEAR_WORDS) -> DataFrame:
    """The documents with their columns, texts without lines that come again.

    A line goes if an equal line stands earlier (by doc_id, then line), or one within one word
    of it and both have near_from words or more. Empty lines stay. Null texts stay null; empty
    texts stay; a document may keep no line and then has an empty text. Rows with one doc_id
    and text count as one document and are treated alike; rows of one doc_id and other texts
    stand at one place. Null doc_ids come first. n_chars, if a whole-number column, follows the
    text. Further columns pass as they are, whatever their names. An empty table gives none.
    """
    return _cut(documents, [], near_from)[0]


def _cut(documents: DataFrame, more: list[str], near_from: int) -> tuple[DataFrame, str]:
    d, t, g, k = (fresh(x, documents.columns) for x in ("_doc", "_text", "_gone", "_key"))
    gone = later_lines(documents, near_from).select(F.col("_doc").alias(d), F.col("_text").alias(t), F.col("_gone").alias(g))
    keyed = documents.withColumn(k, F.xxhash64("text"))
    joined = keyed.join(
        small_enough(gone), F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(k) == F.col(t)), "left"
    )
    lines = F.zip_with(F.split("text", "\n", -1), _flags(F.col(g)), lambda line, gone: F.when(~F.coalesce(gone, F.lit(False)), line))
    left = F.array_join(lines, "\n")
    out = joined.withColumn("text", F.when(F.col(g).isNull(), F.col("text")).otherwise(left))
    if dict(documents.dtypes).get("n_chars") in ("int", "bigint"):
        out = out.withColumn(
            "n_chars", F.when(F.col(g).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(dict(documents.dtypes)["n_chars"])
        )
    return (out.select(*documents.columns, *([F.size(F.col(g)).alias(m) for m in more] if more else [])), g)


def report(documents: DataFrame, near_from: int = NEAR_WORDS) -> DataFrame:
    """Per document: doc_id, n_removed, n_lines_kept, text_sha256 (of the text that is left).

    Null texts count as empty; repeated rows are all returned, alike; an empty table gives
    none; further columns are left out. Lines go as dedup() has it.
    """
    out, _ = _cut(documents.select("doc_id", "text"), ["removed"], near_from)
    return out.select(
        "doc_id",
        F.greatest(F.coalesce("removed", F.lit(0)), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.coalesce("text", F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines_kept"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )
