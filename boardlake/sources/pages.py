"""Landed web pages: job postings in JSON-LD blocks, and site maps with the pages worth reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlake.functions.enrich import decode_entities
from boardlake.functions.text import clean_html, host
from boardlake.registry import query
from boardlake.sources.postings import NOW

_LD = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
PERIODS = {"hour": "hour", "hourly": "hour", "week": "week", "month": "month", "year": "year", "yearly": "year", "annual": "year"}


def jsonld_posting(html: Column) -> Column:
    """The first JobPosting of a page's JSON-LD blocks as JSON text: bare, in a list or in a @graph."""
    blocks = F.transform(F.regexp_extract_all(html, F.lit(_LD), F.lit(1)), lambda b: decode_entities(F.trim(b)))
    text = "array<string>"
    # a bare object gives null as an array; a list or graph gives its members as JSON text
    members = F.flatten(
        F.transform(
            blocks,
            lambda b: F.concat(
                F.when(b.startswith("["), F.coalesce(F.from_json(b, text), F.array().cast(text))).otherwise(F.array(b)),
                F.coalesce(F.from_json(F.get_json_object(b, "$.@graph"), text), F.array().cast(text)),
            ),
        )
    )
    is_job = lambda m: F.lower(F.coalesce(F.get_json_object(m, "$.@type"), F.lit(""))).rlike(r'^(jobposting|\[.*"jobposting".*\])$')
    return F.try_element_at(F.filter(members, is_job), F.lit(1))


def _text(posting: Column, path: str) -> Column:
    return F.nullif(clean_html(F.get_json_object(posting, path)), F.lit(""))


def jsonld_location(posting: Column) -> Column:
    """First address: a text, or town, region and country by commas; TELECOMMUTE alone is Remote."""
    def of(base: str) -> Column:
        address = _text(posting, f"{base}.address")
        parts = F.concat_ws(
            ", ", _text(posting, f"{base}.address.addressLocality"), _text(posting, f"{base}.address.addressRegion"),
            F.coalesce(_text(posting, f"{base}.address.addressCountry.name"), _text(posting, f"{base}.address.addressCountry")),
        )
        return F.when(~address.startswith("{"), address).otherwise(F.nullif(parts, F.lit("")))

    remote = F.upper(F.trim(F.get_json_object(posting, "$.jobLocationType"))) == "TELECOMMUTE"
    return F.coalesce(of("$.jobLocation"), of("$.jobLocation[0]"), F.when(remote, "Remote"))


def jsonld_pay(posting: Column) -> Column:
    """Struct of pay_min, pay_max, pay_currency, pay_period, compensation_type of baseSalary."""
    amount = lambda name: F.coalesce(
        F.get_json_object(posting, f"$.baseSalary.value.{name}"), F.get_json_object(posting, f"$.baseSalary.{name}")
    )
    number = lambda c: F.when(c.try_cast("double") > 0, c.try_cast("double"))
    exact = number(amount("value"))
    periods = F.create_map(*[F.lit(x) for kv in PERIODS.items() for x in kv])
    low, high = F.coalesce(number(amount("minValue")), exact), F.coalesce(number(amount("maxValue")), exact)
    known = low.isNotNull() | high.isNotNull()
    period = F.when(known, periods[F.lower(amount("unitText"))])
    currency = F.when(known, F.upper(F.get_json_object(posting, "$.baseSalary.currency")))
    return F.struct(
        low.alias("pay_min"), high.alias("pay_max"), currency.alias("pay_currency"), period.alias("pay_period"),
        F.when(period == "hour", "hourly").when(period.isNotNull(), "salary").otherwise("unknown").alias("compensation_type"),
    )


def read_jsonld(pages: DataFrame) -> DataFrame:
    """url and the posting's columns of the pages that carry a JobPosting."""
    found = pages.select("url", jsonld_posting(F.col("html")).alias("_p")).filter("_p is not null")
    p = F.col("_p")
    return found.select(
        "url", F.coalesce(_text(p, "$.title"), F.lit("Untitled Position")).alias("title"),
        F.coalesce(_text(p, "$.hiringOrganization.name"), _text(p, "$.hiringOrganization")).alias("company"),
        jsonld_location(p).alias("location"), F.get_json_object(p, "$.datePosted").alias("posting_date"), jsonld_pay(p).alias("_pay"),
    ).select("*", "_pay.*").drop("_pay")


def site_entries(xml: Column) -> Column:
    """Array of (loc, lastmod) of a site map or an index of site maps."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:url|sitemap)\b[^>]*>.*?</(?:url|sitemap)>"), F.lit(0))
    take = lambda b, tag: F.nullif(decode_entities(F.trim(F.regexp_extract(b, rf"(?is)<{tag}>(.*?)</{tag}>", 1))), F.lit(""))
    entries = F.transform(blocks, lambda b: F.struct(take(b, "loc").alias("loc"), take(b, "lastmod").alias("lastmod")))
    return F.filter(entries, lambda e: e["loc"].isNotNull())


def candidates(entries: DataFrame, now: int, days: int, limit: int) -> DataFrame:
    """Of each site the pages to read: under /job, once each, inside the window or undated; newest
    first, undated last, at most limit of a site."""
    when = F.unix_timestamp(F.try_to_timestamp(F.substring("lastmod", 1, 10), F.lit("yyyy-MM-dd")))
    kept = (
        entries.filter(F.col("loc").rlike(r"^https?://[^/]+/.*job")).groupBy("loc").agg(F.max(when).alias("epoch"))
        .filter(F.col("epoch").isNull() | (F.col("epoch") >= now - days * 86_400)).withColumn("site", host(F.col("loc")))
    )
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.desc_nulls_last("epoch"), "loc")).cast("long")
    return kept.withColumn("rank", rank).filter(F.col("rank") <= limit)


@query(
    """SELECT url, 'Job ' || p_name AS title, p_brand AS company, CASE p_partkey % 4 WHEN 0 THEN 'Kent, WA, US' WHEN 1 THEN 'Berlin' WHEN 2 THEN 'Remote' END AS location,
'2024-01-20' AS posting_date, CASE WHEN p_partkey % 3 = 0 THEN 20.0 WHEN p_partkey % 3 = 1 THEN p_retailprice END AS pay_min,
CASE WHEN p_partkey % 3 = 0 THEN 30.0 WHEN p_partkey % 3 = 1 THEN p_retailprice END AS pay_max, CASE WHEN p_partkey % 3 < 2 THEN 'USD' END AS pay_currency,
CASE p_partkey % 3 WHEN 0 THEN 'hour' WHEN 1 THEN 'year' END AS pay_period, CASE p_partkey % 3 WHEN 0 THEN 'hourly' WHEN 1 THEN 'salary' ELSE 'unknown' END AS compensation_type
FROM pages JOIN part ON p_partkey = page_id % 200 WHERE page_id % 5 <> 0"""
)
def io_jsonld(spark, sf_dir) -> DataFrame:
    """JobPostings put into the pages in three shapes (bare, list, graph); every fifth page has none."""
    r, lit = F.col("p_partkey"), F.lit
    address = F.when(r % 4 == 0, lit('{"address": {"addressLocality": "Kent", "addressRegion": "WA", "addressCountry": {"name": "US"}}}')).when(
        r % 4 == 1, lit('[{"address": "Berlin"}]')
    ).otherwise(lit("null"))
    kind = F.when(r % 4 == 2, lit("TELECOMMUTE")).otherwise(lit(""))
    pay = F.when(r % 3 == 0, lit('{"currency": "usd", "value": {"minValue": 20, "maxValue": 30, "unitText": "HOUR"}}')).when(
        r % 3 == 1, F.format_string('{"currency": "USD", "value": {"value": %s, "unitText": "YEAR"}}', F.col("p_retailprice").cast("string"))
    ).otherwise(lit("null"))
    one = F.format_string(
        '{"@type": "JobPosting", "title": "Job &lt;b&gt; %s", "hiringOrganization": {"name": "%s"}, "datePosted": "2024-01-20", "jobLocation": %s, "jobLocationType": "%s", "baseSalary": %s}',
        F.col("p_name"), F.col("p_brand"), address, kind, pay,
    )
    org = '{"@type": "Organization", "name": "x"}'
    block = F.when(r % 3 == 0, one).when(r % 3 == 1, F.format_string(f"[{org}, %s]", one)).otherwise(F.format_string('{"@graph": [' + org + ", %s]}", one))
    script = F.when(F.col("page_id") % 5 != 0, F.concat(lit('<script type="application/ld+json">'), block, lit("</script>"))).otherwise(lit(""))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey < 200")  # 200 rows at any scale
    return read_jsonld(pages.join(F.broadcast(parts), F.col("page_id") % 200 == r).select("url", F.concat("html", script).alias("html")))


@query(
    """WITH e AS (SELECT 'https://site' || (o_custkey % 50) || '.example/' || CASE WHEN o_orderkey % 4 = 0 THEN 'blog/' ELSE 'jobs/' END || (o_orderkey // 2) AS loc,
CASE WHEN o_orderkey % 7 <> 0 THEN 1706659200 - (o_orderkey % 40) * 86400 END AS epoch FROM orders),
k AS (SELECT loc, max(epoch) AS epoch FROM e WHERE loc LIKE '%/jobs/%' GROUP BY 1 HAVING max(epoch) IS NULL OR max(epoch) >= 1706659200 - 14 * 86400),
r AS (SELECT *, regexp_extract(loc, '^https://([^/]+)', 1) AS site FROM k)
SELECT * FROM (SELECT loc, epoch, site, row_number() OVER (PARTITION BY site ORDER BY epoch DESC NULLS LAST, loc) AS rank FROM r) WHERE rank <= 200"""
)
def io_sitemaps(spark, sf_dir) -> DataFrame:
    """Site maps written from the orders, one for each customer, read back, then the pages worth reading."""
    key = F.col("o_orderkey")
    loc = F.concat(
        F.lit("https://site"), (F.col("o_custkey") % 50).cast("string"), F.lit(".example/"),
        F.when(key % 4 == 0, "blog/").otherwise("jobs/"), F.expr("o_orderkey div 2").cast("string"),
    )
    day = F.date_format(F.timestamp_seconds(NOW - (key % 40) * 86_400), "yyyy-MM-dd")
    url = F.concat(F.lit("<url><loc>"), loc, F.lit("</loc>"), F.when(key % 7 != 0, F.concat(F.lit("<lastmod>"), day, F.lit("T00:00:00Z</lastmod>"))).otherwise(""), F.lit("</url>"))
    maps = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(url), "\n"), F.lit("</urlset>")).alias("xml"))
    return candidates(maps.select(F.inline(site_entries(F.col("xml")))), NOW, 14, 200)
