"""Secret scans with DataFrame operations alone.

Base rules find assignments, access keys and long hex strings. Method: candidate values (base
values and further key-like strings) are hashed, and for each hash the documents, the distinct
repositories and the distinct owners are counted over the whole corpus. A value of few
documents, repositories and owners (MOST_DOCUMENTS, MOST_REPOSITORIES, MOST_OWNERS) looks like
a live credential: key-like strings of that sort are added as spans of kind "owned", and base
values of that sort count as owned. A value with more of any is a widely copied example. Base
spans stay whatever their frequency.

Positions come from splitting a text by the same pattern that extracts the matches: pieces
and matches alternate, so running totals of their lengths over a text's matches are the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlake.llm.common import drop, materialise, small_enough

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Key-like strings: 20 characters or more of letters and digits, at least three of them digits.
KEY_LIKE = r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}(?![A-Za-z0-9])"
KINDS = ("assign", "access", "hex", "owned")
#: A value with more of these is a copied example.
MOST_OWNERS, MOST_REPOSITORIES, MOST_DOCUMENTS = 1, 2, 20
_MATCHES = "array<struct<rank:int,gap:int,size:int,value:string>>"


def _matches(text: Column, pattern: str, rank: int, group: int = 0) -> Column:
    """Of each match its kind, the length of the text before it (from the match before it on), its own, and a group's value."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(
        F.transform(F.slice(gaps, F.lit(1), F.size(found)), F.length).alias("gap"), F.transform(found, F.length).alias("size"), value.alias("value")
    )
    rows = F.transform(parts, lambda p: F.struct(F.lit(rank).alias("rank"), p["gap"].alias("gap"), p["size"].alias("size"), p["value"].alias("value")))
    return F.when(text.rlike(pattern), rows.cast(_MATCHES)).otherwise(F.array().cast(_MATCHES))


def scan(documents: DataFrame) -> DataFrame:
    """_doc, _text (hash), _owner, _repo, _rank, _start, _end (exclusive), _value of every base and key-like span.

    Rows with the same doc_id, text, source and language count once."""
    text = F.coalesce(F.col("_all"), F.lit(""))
    docs = documents.filter(F.col("text").rlike(f"(?:{ASSIGN})|{ACCESS}|{HEX}|{KEY_LIKE}")).select(
        F.col("doc_id").alias("_doc"),
        F.xxhash64("text").alias("_text"),
        F.coalesce(F.col("source"), F.lit("")).alias("_owner"),
        F.concat_ws("/", F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))).alias("_repo"),
        F.col("text").alias("_all"),
    )
    every = F.concat(_matches(text, ASSIGN, 0, 2), _matches(text, ACCESS, 1), _matches(text, HEX, 2), _matches(text, KEY_LIKE, 3))
    rows = docs.select("_doc", "_text", "_owner", "_repo", F.posexplode(every).alias("_at", "m")).distinct()
    by = Window.partitionBy("_doc", "_text", "_owner", "_repo", "m.rank").orderBy("_at")  # the matches of one text
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    value = F.col("_value")
    lengths = lambda pattern: F.length(F.regexp_replace(value, pattern, ""))
    key = (lengths("[^0-9]") >= 3) & (lengths("[^A-Za-z]") >= 3)
    return rows.select(
        "_doc", "_text", "_owner", "_repo", F.col("m.rank").alias("_rank"), (end - F.col("m.size")).alias("_start"), end.alias("_end"), F.col("m.value").alias("_value")
    ).filter(F.when(F.col("_rank") == 0, F.length(value) >= 6).when(F.col("_rank") == 3, key).otherwise(True))


def frequency(found: DataFrame) -> DataFrame:
    """_hash, n_documents, n_repos, n_owners of every candidate value; the copies of a value add up before the shuffle."""
    each = found.select("_owner", "_repo", "_doc", "_text", F.sha2("_value", 256).alias("_hash"))
    docs = each.groupBy("_hash", "_owner", "_repo", "_doc", "_text").agg(F.lit(1).alias("one"))
    repos = docs.groupBy("_hash", "_owner", "_repo").agg(F.count("*").alias("documents"))
    owners = repos.groupBy("_hash", "_owner").agg(F.sum("documents").alias("documents"), F.count("*").alias("repos"))
    return owners.groupBy("_hash").agg(F.sum("documents").alias("n_documents"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def secrets(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_base_owned, n_base_copied.

    n_owned are the added spans; n_base_owned and n_base_copied tell the base spans by the
    verdict on their values. Null texts are empty and have no spans. Repeated rows are all
    returned and count once in the frequencies. Null sources are one owner. An empty table
    gives none; further columns are left out. The source is the owner, source and language the
    repository. Work is linear in a text's matches.
    """
    found = materialise(scan(documents))
    few = (F.col("n_owners") <= MOST_OWNERS) & (F.col("n_repos") <= MOST_REPOSITORIES) & (F.col("n_documents") <= MOST_DOCUMENTS)
    verdict = materialise(frequency(found).select(F.col("_hash").alias("_of"), few.alias("_owned")))
    told = found.join(small_enough(verdict), F.sha2("_value", 256) == F.col("_of")).filter((F.col("_rank") < 3) | F.col("_owned"))
    span = F.struct(F.col("_start").alias("start"), F.col("_rank").alias("rank"), F.col("_end").alias("end"))
    of_text = materialise(
        told.groupBy("_doc", "_text").agg(  # the spans of one document
            F.sort_array(F.collect_set(span)).alias("_spans"),
            F.count_distinct(F.when((F.col("_rank") < 3) & F.col("_owned"), span)).alias("_base_owned"),
        )
    )
    drop(found, verdict)
    docs = documents.select("doc_id", F.xxhash64("text").alias("_key"))
    joined = docs.join(small_enough(of_text), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_text")), "left").select(
        "doc_id", F.coalesce("_spans", F.array().cast("array<struct<start:int,rank:int,end:int>>")).alias("s"), F.coalesce("_base_owned", F.lit(0)).cast("long").alias("o")
    )
    count = lambda r: F.size(F.filter("s", lambda x: x["rank"] == r)).cast("long")
    base = F.filter("s", lambda x: x["rank"] < 3)
    return joined.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("s")).alias("spans"),
        count(3).alias("n_owned"),
        F.col("o").alias("n_base_owned"),
        (F.size(base) - F.col("o")).cast("long").alias("n_base_copied"),
    )


def listed(found: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",",
        F.transform(
            found,
            lambda s: F.concat_ws(":", F.element_at(kind, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
    )
