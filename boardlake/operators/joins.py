"""Joins of postings with users' state, companies and scores, and their windows and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlake.functions.text import like_text
from boardlake.operators import filters
from boardlake.registry import query
from boardlake.sources.postings import ACTIONS, NOW, POSTINGS, actions, postings

BLOCKED = ["company src3", "Company  src7 "]
_BLOCKED = "blocked AS (SELECT unnest(['company src3', 'company src7']) AS key)"


def without_blocked(df: DataFrame, blocked: DataFrame) -> DataFrame:
    """Left anti on the company key; Spark broadcasts the list while it is small."""
    keys = blocked.select(like_text(F.col("company_name")).alias("_key")).distinct()
    return df.join(keys, like_text(df["company_name"]) == keys["_key"], "left_anti")


def _blocked(spark) -> DataFrame:
    return spark.createDataFrame([(x,) for x in BLOCKED], "company_name string")


def order(name: str) -> list[Column]:
    """Total orders of a listing."""
    c = F.col
    return {
        "recent": [c("last_seen_epoch").desc_nulls_last(), c("posting_id").desc()],
        "first_seen": [c("first_seen_epoch").desc_nulls_last(), c("posting_id").desc()],
        "company_asc": [F.lower("company_name").asc_nulls_last(), c("posting_id").asc()],
        "match_desc": [c("match_percent").desc_nulls_last(), c("last_seen_epoch").desc_nulls_last(), c("posting_id").desc()],
    }[name]


#: The columns by which a result may be ordered.
TOP_COLUMNS = ("last_seen_epoch", "first_seen_epoch", "posting_date", "company_name", "position_name", "pay_max", "pay_min")


def top_k(column: str, descending: bool = True) -> list[Column]:
    """Order by one of the columns that may be asked for, newest id first among equals."""
    if column not in TOP_COLUMNS:
        raise ValueError(f"column must be one of: {', '.join(TOP_COLUMNS)}")
    return [F.desc_nulls_last(column) if descending else F.asc_nulls_first(column), F.desc("posting_id")]


def tops(df: DataFrame, k: int) -> DataFrame:
    """by ("column ASC" or "column DESC"), posting_id: the first k rows in each order that may be asked for.

    A row is written once for each column beside its value, as number or text; one pass finds the first k upwards, one downwards,
    and each task sends at most k rows an order on.
    """
    kinds = dict(df.dtypes)
    text = lambda c: kinds[c] == "string"
    value = lambda c: F.struct(
        F.lit(c).alias("column"), (F.lit(None).cast("double") if text(c) else F.col(c).cast("double")).alias("number"), (F.col(c) if text(c) else F.lit(None).cast("string")).alias("text")
    )
    each = df.select("posting_id", F.explode(F.array(*map(value, TOP_COLUMNS))).alias("x")).select("posting_id", "x.*")

    def first(way: str) -> DataFrame:
        by = [f(c) for c in ("number", "text") for f in ([F.desc_nulls_last] if way == "DESC" else [F.asc_nulls_first])]
        rank = F.row_number().over(Window.partitionBy("column").orderBy(*by, F.desc("posting_id")))
        return each.withColumn("_r", rank).filter(F.col("_r") <= k).select(F.concat_ws(" ", "column", F.lit(way)).alias("by"), "posting_id")

    return first("ASC").unionByName(first("DESC"))


def after(last_seen: int, posting_id: int, sort: str = "recent") -> Column:
    """Rows after a cursor in the order recent or first_seen."""
    column = {"recent": "last_seen_epoch", "first_seen": "first_seen_epoch"}[sort]
    return (F.col(column) < last_seen) | ((F.col(column) == last_seen) & (F.col("posting_id") < posting_id))


def after_company(company: str, posting_id: int) -> Column:
    """Rows after a cursor in the order company_asc."""
    name = F.lower("company_name")
    return (name > company.lower()) | ((name == company.lower()) & (F.col("posting_id") > posting_id)) | name.isNull()


@query(
    f"""WITH {POSTINGS}, {_BLOCKED} SELECT posting_id, company_name, position_name, location, last_seen_epoch FROM postings
WHERE NOT hidden AND last_seen_epoch >= 1706659200 - 604800 AND (position_name LIKE '%red%' OR company_name LIKE '%red%' OR lower(location) LIKE '%red%')
AND (pay_max IS NULL OR pay_max >= 60000) AND lower(trim(company_name)) NOT IN (SELECT key FROM blocked)
ORDER BY last_seen_epoch DESC, posting_id DESC LIMIT 200"""
)
def q_listing(spark, sf_dir) -> DataFrame:
    """The flagship: newest 200 visible postings of a term and a pay range, blocked companies left out."""
    df = postings(spark, sf_dir).filter(filters.visibility("visible", NOW, 604_800) & filters.search("red") & filters.pay_range(low=60_000))
    return without_blocked(df, _blocked(spark)).orderBy(*order("recent")).limit(200).select(
        "posting_id", "company_name", "position_name", "location", "last_seen_epoch"
    )


@query(f"WITH {POSTINGS}, {_BLOCKED} SELECT company_name, count(*) AS n FROM postings WHERE lower(trim(company_name)) NOT IN (SELECT key FROM blocked) GROUP BY 1")
def jn_blocked(spark, sf_dir) -> DataFrame:
    return without_blocked(postings(spark, sf_dir), _blocked(spark)).groupBy("company_name").agg(F.count("*").alias("n"))


@query(
    f"""WITH {POSTINGS}, {ACTIONS}, s AS (SELECT posting_id, bool_or(action = 'apply') AS applied, bool_or(action = 'ignore') AS ignored FROM actions GROUP BY 1)
SELECT posting_id, coalesce(applied, false) AS applied, coalesce(ignored, false) AS ignored FROM postings LEFT JOIN s USING (posting_id) WHERE NOT coalesce(ignored, false)"""
)
def jn_user_state(spark, sf_dir) -> DataFrame:
    state = actions(spark, sf_dir).groupBy("posting_id").agg(
        F.max(F.col("action") == "apply").alias("applied"), F.max(F.col("action") == "ignore").alias("ignored")
    )
    no = F.lit(False)
    return postings(spark, sf_dir).join(state, "posting_id", "left").select(
        "posting_id", F.coalesce("applied", no).alias("applied"), F.coalesce("ignored", no).alias("ignored")
    ).filter(~F.col("ignored"))


@query(
    f"""WITH {POSTINGS}, c AS (SELECT 'Company src' || (s_suppkey % 20) AS company_name, min(s_suppkey) AS id FROM supplier GROUP BY 1)
SELECT posting_id, id AS company_id, s_name AS source_name FROM postings LEFT JOIN c USING (company_name) LEFT JOIN supplier ON s_suppkey = id"""
)
def jn_first_company(spark, sf_dir) -> DataFrame:
    """Of several companies with one key the one of least id."""
    companies = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(F.lit("Company src"), (F.col("s_suppkey") % 20).cast("string")).alias("company_name"), "s_suppkey", "s_name"
    )
    first = companies.groupBy("company_name").agg(F.min("s_suppkey").alias("company_id"), F.min_by("s_name", "s_suppkey").alias("source_name"))
    return postings(spark, sf_dir).join(first, "company_name", "left").select("posting_id", "company_id", "source_name")


@query(f"WITH {POSTINGS}, {ACTIONS} SELECT posting_id FROM postings WHERE posting_id NOT IN (SELECT posting_id FROM actions WHERE action = 'apply')")
def jn_unscored(spark, sf_dir) -> DataFrame:
    done = actions(spark, sf_dir).filter("action = 'apply'").select("posting_id")
    return postings(spark, sf_dir).select("posting_id").join(done, "posting_id", "left_anti")


@query(
    f"""WITH {POSTINGS} {" UNION ALL ".join(f"SELECT '{c} {d}' AS by, posting_id FROM (SELECT posting_id FROM postings ORDER BY {c} {d} NULLS {'LAST' if d == 'DESC' else 'FIRST'}, posting_id DESC LIMIT 20)" for c in TOP_COLUMNS for d in ("ASC", "DESC"))}"""
)
def or_top_k(spark, sf_dir) -> DataFrame:
    """The first twenty postings by each column, up and down."""
    return tops(postings(spark, sf_dir), 20).select("by", "posting_id")


@query(
    f"""WITH {POSTINGS} (SELECT 'recent' AS sort, posting_id FROM postings WHERE (last_seen_epoch, posting_id) < (1706659200 - 36000, 500) ORDER BY last_seen_epoch DESC, posting_id DESC LIMIT 50)
UNION ALL (SELECT 'first_seen', posting_id FROM postings WHERE (first_seen_epoch, posting_id) < (1706659200 - 36000, 500) ORDER BY first_seen_epoch DESC, posting_id DESC LIMIT 50)
UNION ALL (SELECT 'company_asc', posting_id FROM postings WHERE lower(company_name) > 'company src4' OR (lower(company_name) = 'company src4' AND posting_id > 100) ORDER BY lower(company_name), posting_id LIMIT 50)"""
)
def or_keyset_page(spark, sf_dir) -> DataFrame:
    """The page after a cursor in three orders."""
    df = postings(spark, sf_dir)
    pages = {"recent": after(NOW - 36_000, 500), "first_seen": after(NOW - 36_000, 500, "first_seen"), "company_asc": after_company("Company src4", 100)}
    return reduce(DataFrame.unionByName, [df.filter(c).orderBy(*order(k)).limit(50).select(F.lit(k).alias("sort"), "posting_id") for k, c in pages.items()])


@query(f"WITH {POSTINGS} SELECT posting_id, company_name FROM postings ORDER BY lower(company_name), posting_id LIMIT 30 OFFSET 60")
def or_page(spark, sf_dir) -> DataFrame:
    return postings(spark, sf_dir).orderBy(*order("company_asc")).offset(60).limit(30).select("posting_id", "company_name")


@query(
    """WITH r AS (SELECT s_suppkey, s_nationkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS turn FROM supplier),
n AS (SELECT s_nationkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS source_place FROM r WHERE turn = 1)
SELECT s_suppkey, s_nationkey, turn, source_place, row_number() OVER (ORDER BY turn, source_place) AS place FROM r JOIN n USING (s_nationkey)"""
)
def wn_round_robin(spark, sf_dir) -> DataFrame:
    """Crawl order: each source's companies from stale to fresh, sources taking turns in the order of their stalest company.

    A company's place comes from the number of companies in each turn and of those before it in its own, so companies are
    never ordered in one task; sources and turns are.
    """
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    turn = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")).cast("long")
    ranked = rows.select("s_suppkey", "s_nationkey", "s_acctbal", turn.alias("turn"))
    first = ranked.filter("turn = 1").select("s_nationkey", F.row_number().over(Window.orderBy("s_acctbal", "s_suppkey")).cast("long").alias("source_place"))
    turns = ranked.groupBy("turn").agg(F.count("*").alias("n"))
    before = turns.select("turn", (F.sum("n").over(Window.orderBy("turn")) - F.col("n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("turn").orderBy("source_place"))
    return ranked.join(first, "s_nationkey").join(before, "turn").select("s_suppkey", "s_nationkey", "turn", "source_place", (F.col("_before") + within).alias("place"))


@query(
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"""
)
def wn_latest_application(spark, sf_dir) -> DataFrame:
    """The newest application of each company, kept without a sort."""
    newest = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("m")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(newest).select("o_custkey", "m.o_orderkey", "m.o_orderstatus")


@query(f"WITH {POSTINGS}, {ACTIONS} SELECT DISTINCT posting_id FROM postings WHERE posting_id NOT IN (SELECT posting_id FROM actions)")
def so_minus_active(spark, sf_dir) -> DataFrame:
    return postings(spark, sf_dir).select("posting_id").distinct().join(actions(spark, sf_dir).select("posting_id"), "posting_id", "left_anti")
