"""Totals, facets, coverage and outcome statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardlake.constants import DAY
from boardlake.functions.dates import posting_epoch, window_seconds
from boardlake.functions.geo import _ANSWERS, entries
from boardlake.functions.sources import infer_source
from boardlake.functions.text import title_words
from boardlake.operators import filters
from boardlake.registry import query
from boardlake.sources.postings import NOW, POSTINGS, postings


@query(
    f"""WITH {POSTINGS} SELECT count(*) AS total, count(*) FILTER (NOT hidden AND last_seen_epoch >= 1706659200 - 604800) AS visible,
count(*) FILTER (pay_min IS NULL AND pay_max IS NULL) AS pay_unknown FROM postings"""
)
def ag_query_totals(spark, sf_dir) -> DataFrame:
    return postings(spark, sf_dir).agg(
        F.count("*").alias("total"), F.count_if(filters.visibility("visible", NOW, 604_800)).alias("visible"),
        F.count_if(F.col("pay_min").isNull() & F.col("pay_max").isNull()).alias("pay_unknown"),
    )


#: Values of a facet that are shown.
FACET_CAP = 20_000


def facets(df: DataFrame, cap: int = FACET_CAP) -> DataFrame:
    """facet, value, n: states, cities ("City|ST"), companies, words of titles and sources, the cap most frequent of each by n and
    then by value; and as facet total the numbers of all, visible, hidden and paid postings.

    A row's location, title, company and source are exploded side by side and counted; locations are parsed and titles split
    after that, once for each distinct one.
    """
    pair = lambda name, c: F.struct(F.lit(name).alias("facet"), c.alias("value"))
    paid = F.coalesce("pay_max", "pay_min", F.lit(0.0)) > 0
    raw = F.array_compact(
        F.array(
            pair("location", F.col("location")), pair("title", F.col("position_name")), pair("company", F.nullif(F.trim("company_name"), F.lit(""))),
            pair("source", F.coalesce(infer_source(F.col("job_posting_url")), F.lit("unknown"))),
            pair("total", F.lit("all")), pair("total", F.when(F.col("hidden"), "hidden").otherwise("visible")), F.when(paid, pair("total", F.lit("with_pay"))),
        )
    )
    some = df.select(F.explode(raw).alias("v")).filter("v.value is not null").groupBy("v.facet", "v.value").agg(F.count("*").alias("n"))
    found = F.when(F.col("facet") == "location", entries(F.col("value")))
    some = some.withColumn("entries", found)
    states = F.array_distinct(F.transform(F.filter("entries", lambda e: (e["country"] == "US") & e["state"].isNotNull()), lambda e: e["state"]))
    cities = F.transform(F.filter("entries", lambda e: e["city"].isNotNull() & e["state"].isNotNull()), lambda e: F.concat_ws("|", e["city"], e["state"]))
    values = (
        F.when(F.col("facet") == "location", F.concat(F.transform(states, lambda x: pair("state", x)), F.transform(cities, lambda x: pair("city", x))))
        .when(F.col("facet") == "title", F.transform(title_words(F.col("value")), lambda w: pair("title", w))).otherwise(F.array(F.struct("facet", "value")))
    )
    counts = some.select("n", F.explode(values).alias("v")).groupBy("v.facet", "v.value").agg(F.sum("n").alias("n"))
    # the distinct values of a facet, not its rows, are put in order
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counts.withColumn("_r", rank).filter(F.col("_r") <= cap).drop("_r")


@query(
    f"""WITH {POSTINGS}, {_ANSWERS}, v AS (SELECT 'company' AS facet, company_name AS value FROM postings UNION ALL SELECT 'source', 'unknown' FROM postings
UNION ALL SELECT 'total', 'all' FROM postings UNION ALL SELECT 'total', CASE WHEN hidden THEN 'hidden' ELSE 'visible' END FROM postings UNION ALL SELECT 'total', 'with_pay' FROM postings WHERE coalesce(pay_max, pay_min, 0) > 0
UNION ALL SELECT 'state', state FROM (SELECT DISTINCT posting_id, state FROM postings JOIN answers USING (location) WHERE country = 'US' AND state IS NOT NULL)
UNION ALL SELECT 'city', city || '|' || state FROM postings JOIN answers USING (location) WHERE state IS NOT NULL
UNION ALL SELECT 'title', unnest(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(position_name), '[^a-z0-9&/ -]', ' ', 'g'), '[ /-]+'),
lambda x: length(x) > 2 AND x NOT IN ('and', 'for', 'the', 'with') AND NOT regexp_matches(x, '^[0-9]+$')))) FROM postings),
c AS (SELECT facet, value, count(*) AS n FROM v GROUP BY 1, 2)
SELECT facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS r FROM c) WHERE r <= 20000"""
)
def ag_facets(spark, sf_dir) -> DataFrame:
    return facets(postings(spark, sf_dir))


@query(
    f"""WITH {POSTINGS}, c AS (SELECT DISTINCT 'Company src' || (s_suppkey % 30) AS company_name FROM supplier)
SELECT company_name, count(posting_id) AS total, count(*) FILTER (NOT hidden AND last_seen_epoch >= 1706659200 - 604800) AS visible, max(last_seen_epoch) AS last_seen
FROM c LEFT JOIN postings USING (company_name) GROUP BY 1"""
)
def ag_company_stats(spark, sf_dir) -> DataFrame:
    """Companies without postings are kept with zeros."""
    facts = postings(spark, sf_dir).groupBy("company_name").agg(
        F.count("*").alias("total"), F.count_if(filters.visibility("visible", NOW, 604_800)).alias("visible"), F.max("last_seen_epoch").alias("last_seen")
    )
    companies = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(F.lit("Company src"), (F.col("s_suppkey") % 30).cast("string")).alias("company_name")
    ).distinct()
    zero = F.lit(0)
    return companies.join(facts, "company_name", "left").select("company_name", F.coalesce("total", zero).alias("total"), F.coalesce("visible", zero).alias("visible"), "last_seen")


@query(
    """SELECT count(*) AS enabled, count(*) FILTER (last IS NULL) AS never, count(*) FILTER (last >= 1706659200 - 172800) AS within_window,
count(*) FILTER (last < 1706659200 - 172800) AS stale, max(1706659200 - last) AS oldest_age FROM
(SELECT c_custkey, max(floor(epoch(ts))::BIGINT) AS last FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1)"""
)
def ag_coverage(spark, sf_dir) -> DataFrame:
    """How many targets were reached in the window, never, or too long ago."""
    seen = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max(F.unix_timestamp("ts")).alias("last"))
    cutoff = NOW - 172_800
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").join(seen, "c_custkey", "left").agg(
        F.count("*").alias("enabled"), F.count_if(F.col("last").isNull()).alias("never"), F.count_if(F.col("last") >= cutoff).alias("within_window"),
        F.count_if(F.col("last") < cutoff).alias("stale"), F.max(NOW - F.col("last")).alias("oldest_age"),
    )


@query(
    """WITH s AS (SELECT c_mktsegment AS company, count(*) AS applications, count(*) FILTER (o_orderstatus = 'F') AS denied,
round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS mean_value, round(median(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS median_value
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT *, round(denied * 100.0 / applications, 2)::DOUBLE AS denial_rate FROM s"""
)
def ag_denial_stats(spark, sf_dir) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").join(
        spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_mktsegment").alias("company")), F.col("o_custkey") == F.col("c_custkey")
    )
    denied = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return orders.groupBy("company").agg(
        F.count("*").alias("applications"), F.count_if(F.col("o_orderstatus") == "F").alias("denied"),
        F.round(F.avg(denied), 2).alias("mean_value"), F.round(F.median(denied), 2).alias("median_value"),
    ).withColumn("denial_rate", F.round(F.col("denied") * 100.0 / F.col("applications"), 2).cast("double"))


@query(
    """WITH t AS (SELECT DISTINCT p_brand AS industry, lower(p_name || ' ' || p_type) AS title FROM part),
w AS (SELECT DISTINCT industry, title, unnest(string_split(title, ' ')) AS word FROM t),
c AS (SELECT industry, word, count(*) AS titles FROM w GROUP BY 1, 2), d AS (SELECT word, count(DISTINCT industry) AS industries FROM w GROUP BY 1)
SELECT industry, word, titles, industries FROM c JOIN d USING (word) WHERE titles >= 3"""
)
def ag_industry_words(spark, sf_dir) -> DataFrame:
    """Words that mark an industry: in three titles or more, with the number of industries that use them."""
    titles = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_brand").alias("industry"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("title")
    ).distinct()
    words = titles.select("industry", "title", F.explode(F.array_distinct(F.split("title", " "))).alias("word"))
    counts = words.groupBy("industry", "word").agg(F.count("*").alias("titles"))
    spread = counts.groupBy("word").agg(F.count("*").alias("industries"))
    return counts.filter("titles >= 3").join(spread, "word").select("industry", "word", "titles", "industries")


@query("SELECT event_type AS source, count(*) AS n, count(*) FILTER (value < 5) AS failed FROM events GROUP BY 1")
def ag_failed_by_source(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("source")).agg(
        F.count("*").alias("n"), F.count_if(F.col("value") < 5).alias("failed")
    )


def export(df: DataFrame, now: int, hours: int = 168, chunk: int = 300, most: int | None = None, budget: int | None = None) -> DataFrame:
    """Publishable rows of each source with their chunk (from 0): visible, with a readable date in the window; newest date first,
    then last seen, then id; at most so many of a source, and while the bytes of their descriptions fit the budget.

    Rows are dealt by source and day, and a source's days are added up from their counts, so no task orders a whole source.
    """
    kept = df.filter(~F.col("hidden")).withColumn("_e", posting_epoch(F.col("posting_date"), now)).filter(F.col("_e") >= now - window_seconds(hours))
    kept = kept.withColumns({"bytes": F.octet_length(F.coalesce("job_description", F.lit(""))).cast("long"), "_day": F.floor(F.col("_e") / DAY)})
    days = kept.groupBy("source", "_day").agg(F.count("*").alias("_n"), F.sum("bytes").alias("_b"))
    later = Window.partitionBy("source").orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    before = days.select(F.col("source").alias("_s"), F.col("_day").alias("_d"), F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_b").over(later), F.lit(0)).alias("_b0"))
    within = Window.partitionBy("source", "_day").orderBy(F.desc("_e"), F.desc("last_seen_epoch"), "posting_id")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = kept.withColumns({"_r": F.row_number().over(within), "_u": F.sum("bytes").over(upto)}).join(before, (F.col("source") == F.col("_s")) & (F.col("_day") == F.col("_d")))
    rows = rows.withColumns({"place": F.col("_n0") + F.col("_r") - 1, "_used": F.col("_b0") + F.col("_u")})
    if most is not None:
        rows = rows.filter(F.col("place") < most)
    if budget is not None:
        rows = rows.filter(F.col("_used") <= budget)
    return rows.withColumn("chunk", F.floor(F.col("place") / chunk)).drop("_e", "_day", "_s", "_d", "_n0", "_b0", "_r", "_u", "_used")


def write_chunks(rows: DataFrame, folder: str) -> None:
    """One folder of JSON lines for each source and chunk."""
    rows.write.partitionBy("source", "chunk").json(folder)


@query(
    f"""WITH {POSTINGS}, d AS (SELECT *, CASE WHEN t = 'yesterday' THEN 1706659200 - 86400 WHEN regexp_matches(t, '^[0-9]+ days ago$') THEN 1706659200 - regexp_extract(t, '([0-9]+)', 1)::BIGINT * 86400 ELSE epoch(try_strptime(t, '%Y-%m-%d'))::BIGINT END AS e
FROM (SELECT *, lower(trim(posting_date)) AS t FROM postings)),
o AS (SELECT source, posting_id, octet_length(encode(job_description)) AS bytes, row_number() OVER w - 1 AS r, sum(octet_length(encode(job_description))) OVER (w ROWS UNBOUNDED PRECEDING) AS used
FROM d WHERE NOT hidden AND e >= 1706659200 - 604800 WINDOW w AS (PARTITION BY source ORDER BY e DESC, last_seen_epoch DESC, posting_id))
SELECT source, r // 5 AS chunk, count(*) AS items, sum(bytes)::BIGINT AS bytes FROM o WHERE r < 400 AND used <= 200000 GROUP BY 1, 2"""
)
def io_export_chunks(spark, sf_dir) -> DataFrame:
    """Manifest of the extract: chunks of five postings of a source, at most 400 and 200,000 bytes of each."""
    rows = export(postings(spark, sf_dir), NOW, chunk=5, most=400, budget=200_000)
    return rows.groupBy("source", "chunk").agg(F.count("*").alias("items"), F.sum("bytes").alias("bytes"))
